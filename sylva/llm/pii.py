"""Information-theoretic sanitisation of personal data, with DataFrame functions only.

Patterns find protected entities (mail and network addresses, payment cards, phone
numbers).  Corpus co-occurrence then tells which ordinary terms give an entity away:
with the numbers n(term), n(entity) of documents that hold them and n(entity, term) of
documents that hold the term near the entity, out of N documents, a term's disclosure of
an entity is its pointwise mutual information over the entity's information content,

    log(N * n(e, t) / (n(e) * n(t))) / log(N / n(e)),

which is 1 when the term occurs nowhere else.  A term that discloses an entity near it is
generalised (to its kind of word) from ``GENERALISE`` on and removed from ``REMOVE`` on,
wherever else it stands in that document too.  Every pair is decided, those seen once
included: most personal data are.  All counts are of documents, so copies raise them
alike and a document's copies hide nothing.

Work in one text is in proportion to its length and to the spans in it, for long lists of
addresses as well: places come from blocked running sums, windows from blocks of the text.

Shuffles: pairs near entities and their counts, pre-aggregated; the terms of documents
that hold an entity, with their places; no text moves.  Words of the whole corpus are
counted once, pre-aggregated by sender, and kept for the terms that some pair needs.

Defined results: a null or empty text has no spans; a null id is kept; repeated rows are
reported once each; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.llm.common import in_blocks, let, materialize, piece, replaced, running

#: kind -> Java pattern, in the order in which kinds are listed.  Possessive, so that no run of
#: characters is scanned twice; look-behinds only skip starts at which a longer match has failed.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
HINTS = {"email": "@", "phone": "+"}
KINDS = tuple(PATTERNS)
WINDOW, TERM_LENGTH, GENERALISE, REMOVE = 80, 2, 0.6, 0.8
#: Letters and digits of spans are hidden as the first of these, their other characters as the second.
HIDDEN = ("\x01", "\x02")
#: A whole word; one that runs into a span is none.
TERM = r"(?<![\p{L}\p{N}\x01])[\p{L}\p{N}]{%d,}+(?!\x01)" % TERM_LENGTH
SPAN = "array<struct<start:int,end:int,m:string>>"


def located(text: Column, pattern: str) -> Column:
    """Start, end (code points) and string of the leftmost non-overlapping matches."""

    def of(t: Column) -> Column:
        def placed(found: Column) -> Column:
            gaps, matches = found["g"], found["m"]
            sizes = F.transform(matches, lambda m, i: F.struct(F.length(F.get(gaps, i)).alias("gap"), F.length(m).alias("own")))

            def spans(z: Column) -> Column:
                before = running(F.transform(z, lambda y: y["gap"] + y["own"]), F.lit(0), lambda a, b: a + b)
                of_one = lambda b, m, i: let(F.get(b, i) + F.get(z, i)["gap"], lambda start: F.struct(start.alias("start"), (start + F.get(z, i)["own"]).alias("end"), m.alias("m")))
                return let(before, lambda b: F.transform(matches, lambda m, i: of_one(b, m, i)))

            return let(sizes, spans)

        return let(F.struct(F.split(t, pattern, -1).alias("g"), F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("m")), placed)

    return F.when(F.regexp_like(text, F.lit(pattern)), of(text)).otherwise(F.array().cast(SPAN))


def luhn(digits: Column) -> Column:
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda d, i: let(d.cast("int") * (1 + i % 2), lambda v: F.when(v > 9, v - 9).otherwise(v)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return F.regexp_like(m, F.lit(rf"^{part}(?:\.{part}){{3}}$"))
    if kind == "card":
        digits = F.translate(m, " -", "")
        return F.length(digits).between(12, 19) & luhn(digits)
    if kind == "phone":
        return F.length(F.translate(m, " ().+-", "")).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """All valid spans as (start, rank, kind, end, m), sorted."""

    def of(kind: str, rank: int) -> Column:
        spans = F.transform(
            F.filter(located(text, PATTERNS[kind]), lambda x: valid(kind, x["m"])),
            lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["end"].alias("end"), x["m"].alias("m")),
        )
        return F.when(F.contains(text, F.lit(HINTS[kind])), spans).otherwise(F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,m:string>>")) if kind in HINTS else spans

    return F.array_sort(F.concat(*[of(k, r) for r, k in enumerate(KINDS)]))


def entity(x: Column) -> Column:
    """One name for all spellings of an entity."""
    return F.concat_ws(":", x["kind"], F.when(x["kind"].isin("card", "phone"), F.regexp_replace(x["m"], "[^0-9]", "")).otherwise(F.lower(x["m"])))


def hidden(text: Column, spans: Column, kind: str) -> Column:
    """``text`` with the characters of the spans of one kind hidden, in as many code points.  Spans of one kind are disjoint."""

    def mask(m: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(m, r"[^\p{L}\p{N}]", HIDDEN[1]), r"[\p{L}\p{N}]", HIDDEN[0])

    return let(F.struct(text.alias("t"), F.filter(spans, lambda x: x["kind"] == kind).alias("s")), lambda z: replaced(z["t"], z["s"], lambda y: mask(y["m"])))


def around(blocks: Column, n: Column, x: Column) -> Column:
    """Whole terms that lie within ``WINDOW`` code points of a span, in a text in blocks whose spans are hidden."""
    first, last = F.greatest(x["start"] - WINDOW - 1, F.lit(0)), F.least(x["end"] + WINDOW + 1, n)
    # a word that the window's outer edge may cut is left out
    left = F.regexp_replace(piece(blocks, first, x["start"]), r"^[\p{L}\p{N}]+", F.when(x["start"] > WINDOW, F.lit(" ")).otherwise(F.lit("$0")))
    right = F.regexp_replace(piece(blocks, x["end"], last), r"[\p{L}\p{N}]+\z", F.when(x["end"] + WINDOW < n, F.lit(" ")).otherwise(F.lit("$0")))
    # what touches the span runs into it
    edge = F.lit(HIDDEN[0])
    joined = F.concat(left, F.when(F.rlike(x["m"], F.lit(r"^[\p{L}\p{N}]")), edge).otherwise(HIDDEN[1]), F.when(F.rlike(x["m"], F.lit(r"[\p{L}\p{N}]\z")), edge).otherwise(HIDDEN[1]), right)
    return F.transform(F.regexp_extract_all(joined, F.lit(TERM), F.lit(0)), lambda m: F.concat_ws(HIDDEN[0], entity(x), F.lower(m)))


def mentions(docs: DataFrame) -> DataFrame:
    """(doc_id, h, spans, near, terms) of every row, written once: all later steps read this narrow table.

    ``near`` has the (entity, term) pairs within the window, ``terms`` the places of all terms outside spans;
    both are null without spans.
    """
    whole = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).select("doc_id", F.xxhash64("t").alias("h"), "t", let(F.col("t"), base_spans).alias("spans"))

    open_ = whole.select("doc_id", "h", "spans", F.when(F.size("spans") > 0, F.col("t")).alias("t"))
    for k in KINDS:  # a column each: one expression of all would be nested too deeply for the analyzer
        open_ = open_.withColumn("t", hidden(F.col("t"), F.col("spans"), k))
    # bound as a variable: a column of its own would be copied into the function and cut for every span
    once = F.struct(in_blocks(F.col("t")).alias("b"), F.length("t").alias("n"))
    # as strings while they are made distinct, which structs are only by comparing all with all
    near = let(once, lambda y: F.array_distinct(F.flatten(F.transform("spans", lambda x: around(y["b"], y["n"], x)))))
    terms = F.transform(located(F.col("t"), TERM), lambda x: F.struct(F.lower(x["m"]).alias("term"), x["m"].alias("as_is"), x["start"].alias("start"), x["end"].alias("end")))
    found = F.col("t").isNotNull()
    return materialize(open_.select("doc_id", "h", "spans", F.when(found, F.transform(near, lambda p: F.struct(F.substring_index(p, HIDDEN[0], 1).alias("entity"), F.substring_index(p, HIDDEN[0], -1).alias("term")))).alias("near"), F.when(found, terms).alias("terms")), "mentions")


def disclosing(docs: DataFrame, seen: DataFrame) -> DataFrame:
    """(entity, term, disclosure) of the pairs from ``GENERALISE`` on, from counts over all documents."""
    n_docs = docs.count()
    pairs = seen.filter("near is not null").select(F.explode("near").alias("x")).select("x.entity", "x.term")
    joint = materialize(pairs.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_et")), "joint")
    holders = seen.select(F.explode(F.array_distinct(F.transform("spans", entity))).alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    wanted = materialize(joint.select(F.col("term").alias("wanted")).distinct(), "wanted")
    words = docs.select(F.explode(F.array_distinct(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= TERM_LENGTH))).alias("term"))
    # counted before the join, so that the join's size is that of the vocabulary and not of the corpus
    counts = words.groupBy("term").agg(F.count(F.lit(1)).alias("n_t")).join(wanted, F.col("term") == F.col("wanted")).select("term", "n_t")
    total = F.lit(float(max(n_docs, 2)))
    content = F.log(F.greatest(total / F.col("n_e"), F.lit(1.0 + 1e-9)))
    shared = F.log(total * F.col("n_et") / (F.col("n_e") * F.greatest("n_t", "n_et")))
    score = F.least(shared / content, F.lit(1.0))
    return joint.join(holders, "entity").join(counts, "term").select("entity", "term", score.alias("disclosure")).filter(F.col("disclosure") >= GENERALISE)


def all_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, h, spans, added): base spans, and the disclosing terms of their entities as (start, rank, kind, end, m)."""
    seen = mentions(docs)
    risky = materialize(disclosing(docs, seen), "disclosing")
    held = seen.filter("near is not null").select("doc_id", "h", F.explode("near").alias("x")).select("doc_id", "h", "x.entity", "x.term").join(risky, ["entity", "term"])
    terms = held.groupBy(F.col("doc_id").alias("d2"), F.col("h").alias("h2"), F.col("term").alias("t2")).agg(F.max("disclosure").alias("disclosure"))
    places = seen.filter("terms is not null").select("doc_id", "h", F.explode("terms").alias("x")).select("doc_id", "h", "x.term", "x.as_is", "x.start", "x.end")
    gone = F.col("disclosure") >= REMOVE
    kind, rank = F.when(gone, "remove").otherwise("generalise"), F.when(gone, F.lit(len(KINDS) + 1)).otherwise(F.lit(len(KINDS)))
    hits = places.join(terms, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("h") == F.col("h2")) & (F.col("term") == F.col("t2")))
    span = F.struct("start", rank.alias("rank"), kind.alias("kind"), "end", F.col("as_is").alias("m"))
    added = hits.groupBy(F.col("doc_id").alias("d3"), F.col("h").alias("h3")).agg(F.sort_array(F.collect_set(span)).alias("added"))  # rows repeated in the table are one set
    joined = seen.select("doc_id", "h", "spans").join(added, F.col("doc_id").eqNullSafe(F.col("d3")) & (F.col("h") == F.col("h3")), "left")
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,m:string>>")
    return joined.select("doc_id", "h", "spans", F.coalesce("added", none).alias("added"))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def digest(docs: DataFrame) -> DataFrame:
    """The result of query op1."""

    def n(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return all_spans(docs).select(
        "doc_id", *[n(k) for k in KINDS], F.sha2(spans_text(F.col("spans")), 256).alias("base_sha256"),
        spans_text(F.array_sort(F.concat("spans", "added"))).alias("spans"), F.size("added").cast("long").alias("n_terms"),
    )


def general(term: Column) -> Column:
    """What is left of a generalised term: the kind of word it is."""
    kind = F.when(F.rlike(term, F.lit(r"^\p{N}+\z")), "number").when(F.rlike(term, F.lit(r"\p{N}")), "code").when(F.rlike(term, F.lit(r"^\p{Lu}")), "name").otherwise("word")
    return F.concat(F.lit("["), kind, F.lit("]"))


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with entities replaced by their kind, disclosing terms generalised to the kind of word they are or removed."""
    found = all_spans(docs).filter("size(spans) > 0").select(F.col("doc_id").alias("__sylva_d"), F.col("h").alias("__sylva_h"), F.array_sort(F.concat("spans", "added")).alias("__sylva_s")).distinct()
    joined = docs.withColumn("__sylva_x", F.xxhash64(F.coalesce("text", F.lit("")))).join(found.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("__sylva_d")) & (F.col("__sylva_x") == F.col("__sylva_h")), "left")

    def mark(y: Column) -> Column:
        return F.when(y["kind"] == "remove", F.lit("")).when(y["kind"] == "generalise", general(y["m"])).otherwise(F.concat(F.lit("["), y["kind"], F.lit("]")))

    clean = F.when(F.col("__sylva_s").isNull(), F.col("text")).otherwise(replaced(F.col("text"), F.col("__sylva_s"), mark))
    return joined.withColumn("text", clean).select(*[F.col(f"`{c}`") for c in docs.columns])
