"""More registered queries: operators that no headline query reaches, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sylva.functions import text
from sylva.operators import attrs, axes, css, mutate, positions
from sylva.plans import twin
from sylva.plans.catalog import _ORDERS, _PLACED, _TREE, attr, customers, long, query, table
from sylva.sources.shred import shred

_ALL = f"SELECT 'nation' AS name FROM customer UNION ALL SELECT 'customer' FROM customer UNION ALL SELECT 'order' FROM ({_ORDERS}) UNION ALL SELECT 'line' FROM ({_PLACED})"


def _by_name(forest):
    return axes.nodes(forest).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


# -- scalars -------------------------------------------------------------------------


@query("""SELECT doc_id, CAST(length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '"', '&quot;')) AS BIGINT) AS quoted, CAST(length(replace(text, '--', '-&#x2d;')) AS BIGINT) AS in_comment,
  CAST(length(replace(text, '?>', '?&gt;')) AS BIGINT) AS in_pi, CAST(length(replace(text, ']]>', ']]&gt;')) AS BIGINT) AS in_cdata FROM documents""")
def escaped_lengths(spark, sf_dir):
    """Escapes of attribute values, comments, instructions and marked sections."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", long(F.length(text.escape_attribute(t)), "quoted"), long(F.length(text.escape_comment(t)), "in_comment"), long(F.length(text.escape_pi(t)), "in_pi"), long(F.length(text.escape_cdata(t)), "in_cdata")
    )


@query("""SELECT doc_id, md5(array_to_string(list_transform(regexp_extract_all(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), ']]>', ']]&gt;'), '(?s).'), lambda c: CASE WHEN unicode(c) > 127 THEN '&#X' || lpad(to_hex(unicode(c)), CAST(greatest(4, length(to_hex(unicode(c)))) AS INTEGER), '0') || ';' ELSE c END), '')) AS digest
  FROM documents WHERE text IS NOT NULL""")
def ascii_escapes(spark, sf_dir):
    """References for everything beyond ASCII, over whole texts."""
    d = table(spark, sf_dir, "documents").filter("text is not null")
    return d.select("doc_id", F.md5(text.escape_ascii(F.col("text"), names=False)).alias("digest"))


@query("SELECT doc_id, md5(text) AS digest FROM documents WHERE text IS NOT NULL AND NOT contains(text, '&')")
def escapes_undone(spark, sf_dir):
    """What was escaped comes back."""
    d = table(spark, sf_dir, "documents").filter("text is not null and not contains(text, '&')")
    return d.select("doc_id", F.md5(text.unescape(text.escape_ascii(F.col("text")), "keep")).alias("digest"))


@query("SELECT p_partkey AS part, substr(p_type, 2, 3) AS some, substr(p_type, 1, 1) || '*' || substr(p_type, 2) AS more, substr(p_type, 4) AS less, '#' || substr(p_type, 3) AS other, p_type || '!' AS longer FROM part")
def data_edits(spark, sf_dir):
    """Edits of character data by offsets."""
    s = F.col("p_type")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("part"), text.substring_data(s, 1, 3).alias("some"), text.insert_data(s, 1, "*").alias("more"), text.delete_data(s, 0, 3).alias("less"),
        text.replace_data(s, 0, 2, "#").alias("other"), text.append_data(s, "!").alias("longer"),
    )


@query("""SELECT p_partkey AS part, CASE WHEN list_contains(t, 'NEW') THEN s ELSE s || ' NEW' END AS added, array_to_string(list_filter(t, lambda x: x <> 'STEEL'), ' ') AS removed,
  CASE WHEN list_contains(t, 'BRASS') THEN array_to_string(list_filter(t, lambda x: x <> 'BRASS'), ' ') ELSE s || ' BRASS' END AS toggled, array_to_string(list_transform(t, lambda x: CASE WHEN x = 'TIN' THEN 'ZINC' ELSE x END), ' ') AS renamed
  FROM (SELECT p_partkey, p_type AS s, string_split(p_type, ' ') AS t FROM part)""")
def token_edits(spark, sf_dir):
    """Token sets: add, remove, toggle, replace."""
    s = F.col("p_type")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("part"), text.add_token(s, "NEW").alias("added"), text.remove_token(s, "STEEL").alias("removed"), text.toggle_token(s, "BRASS").alias("toggled"), text.replace_token(s, "TIN", "ZINC").alias("renamed")
    )


@query("SELECT o_orderkey AS order_key, CAST(o_orderkey AS BIGINT) AS plain, CAST(-o_orderkey AS BIGINT) AS negative, CAST(o_orderkey AS BIGINT) AS from_hex, CAST(o_orderkey AS DOUBLE) / 4 AS quarter FROM orders")
def parsed_numbers(spark, sf_dir):
    """Integers in several bases and floats out of text."""
    k = F.col("o_orderkey").cast("string")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_key"), text.parse_int(k).alias("plain"), text.parse_int(F.concat(F.lit("-"), k)).alias("negative"),
        text.parse_int(F.concat(F.lit("0x"), F.lower(F.hex("o_orderkey"))), 16).alias("from_hex"), text.parse_float((F.col("o_orderkey").cast("double") / 4).cast("decimal(20,2)").cast("string")).alias("quarter"),
    )


@query("SELECT o_orderkey AS order_key, chr(CAST(192 + o_orderkey % 9000 AS INTEGER)) AS letter FROM orders")
def characters(spark, sf_dir):
    """Characters by code point."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_key"), text.char_of(192 + F.col("o_orderkey") % 9000).alias("letter"))


@query("SELECT o_orderkey AS order_key, string_split(replace(o_orderpriority, '-', ':'), ':')[1] AS pfx, substr(o_orderpriority, position('-' IN o_orderpriority) + 1) AS loc FROM orders WHERE contains(o_orderpriority, '-')")
def qualified_names(spark, sf_dir):
    """Prefix and local part."""
    q = F.replace(F.col("o_orderpriority"), F.lit("-"), F.lit(":"))
    return table(spark, sf_dir, "orders").filter(F.contains("o_orderpriority", F.lit("-"))).select(F.col("o_orderkey").alias("order_key"), text.prefix_part(q).alias("pfx"), text.local_part(q).alias("loc"))


@query("SELECT CAST(count(*) FILTER (regexp_full_match(p_type, '[A-Za-z_][A-Za-z_0-9.:-]*')) AS BIGINT) AS names, CAST(count(*) FILTER (regexp_full_match(replace(p_type, ' ', '_'), '[A-Za-z_][A-Za-z_0-9.:-]*')) AS BIGINT) AS joined, CAST(count(*) AS BIGINT) AS uris FROM part")
def name_tests(spark, sf_dir):
    """Names by rule, namespace identifiers."""
    s = F.col("p_type")
    ok = text.NAME_TESTS["ASCII"]
    return table(spark, sf_dir, "part").agg(F.count_if(ok(s)).alias("names"), F.count_if(ok(F.replace(s, F.lit(" "), F.lit("_")))).alias("joined"), F.count_if(text.is_namespace_uri(F.concat(F.lit("http://x/"), "p_partkey"))).alias("uris"))


# -- parser --------------------------------------------------------------------------


@query("SELECT CAST(n_nationkey AS BIGINT) AS nation, n_name || ' & ' || n_name AS content, 'eur' AS currency, 'key' || n_nationkey AS given, '&lt;' AS kept FROM nation")
def declared_entities(spark, sf_dir):
    """A document type with entities, nested ones too, and default attributes; marked sections stay text."""
    n = table(spark, sf_dir, "nation")
    doc = F.concat(
        F.lit('<!DOCTYPE r [<!ELEMENT r (#PCDATA|s)*><!ENTITY one "'), F.col("n_name"), F.lit('"><!ENTITY two "&one; &#38;#38; &one;"><!ATTLIST r c CDATA "eur" k CDATA #IMPLIED>]><r k="key'), F.col("n_nationkey").cast("string"),
        F.lit('">&two;<s><![CDATA[&lt;]]></s></r>'),
    )
    forest = shred(n.select("n_nationkey", doc.alias("text")), "n_nationkey", "text")
    r = forest.filter("name = 'r'").select("doc_id", "pre", attr("c").alias("currency"), attr("k").alias("given"))
    own = forest.filter("node_type = 3 and parent = 0").groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pre", "data"))), lambda x: x["data"]), "").alias("content"))
    kept = forest.filter("in_cdata").select("doc_id", F.col("data").alias("kept"))
    return r.join(own, "doc_id").join(kept, "doc_id").select(F.col("doc_id").alias("nation"), "content", "currency", "given", "kept")


@query("SELECT CAST(n_nationkey AS BIGINT) AS nation, CAST(CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS broken FROM nation")
def broken_documents(spark, sf_dir):
    """A document that is not well formed is one error row and stops no other."""
    n = table(spark, sf_dir, "nation")
    doc = F.when(F.col("n_nationkey") % 2 == 0, "<a><b></a>").otherwise("<a><b/></a>")
    forest = shred(n.select("n_nationkey", doc.alias("text")), "n_nationkey", "text")
    bad = axes.errors(forest).select("doc_id").distinct().withColumn("broken", F.lit(1).cast("long"))
    return n.join(bad, F.col("n_nationkey") == F.col("doc_id"), "left").select(long("n_nationkey", "nation"), F.coalesce("broken", F.lit(0).cast("long")).alias("broken"))


# -- axes and attributes ---------------------------------------------------------------


@query("SELECT l_orderkey AS order_key, CAST(count(*) * (count(*) - 1) // 2 AS BIGINT) AS n_pairs FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1 HAVING count(*) > 1")
def preceding_line_pairs(spark, sf_dir):
    """Preceding-sibling axis."""
    forest = customers(spark, sf_dir)
    up = forest.filter("name = 'order'").select("doc_id", F.col("pre").alias("parent"), attr("key", "long").alias("order_key"))
    return axes.preceding_siblings(forest, forest.filter("name = 'line'")).join(up, ["doc_id", "parent"]).groupBy("order_key").agg(F.count(F.lit(1)).alias("n_pairs"))


@query(f"SELECT c_custkey AS customer, CAST(count(*) * (count(*) - 1) // 2 AS BIGINT) AS n FROM ({_ORDERS}) GROUP BY 1 HAVING count(*) > 1")
def later_orders(spark, sf_dir):
    """Following axis: pairs of orders of a document."""
    forest = customers(spark, sf_dir)
    return axes.following(forest, forest.filter("name = 'order'"), F.col("name") == "order", xpath=True).groupBy(F.col("doc_id").alias("customer")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT name, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN o_orderkey IS NULL THEN 'customer' WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) THEN 'line' ELSE 'order' END AS name FROM customer c LEFT JOIN (SELECT o_custkey AS k, o_orderkey FROM ({_ORDERS}) WHERE opos = 1) ON k = c.c_custkey) GROUP BY name")
def leftmost_nodes(spark, sf_dir):
    """The deepest first node of every document."""
    forest = customers(spark, sf_dir)
    return _by_name(axes.leftmost(forest, forest.filter("pre = 0")))


@query(f"SELECT CAST(count(*) FILTER (pos = 1) AS BIGINT) AS firsts, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS lasts FROM ({_PLACED})")
def first_and_last_lines(spark, sf_dir):
    """Tests for first and last children."""
    lines = customers(spark, sf_dir)
    firsts = lines.filter(axes.is_first_child() & (F.col("name") == "line")).agg(F.count(F.lit(1)).alias("firsts"))
    return firsts.join(axes.last_children(lines).filter("name = 'line'").agg(F.count(F.lit(1)).alias("lasts")), F.lit(True))


@query(f"SELECT CAST(sum(l_quantity) AS BIGINT) AS qty, CAST(sum(l_suppkey) AS BIGINT) AS supp, CAST(count(*) AS BIGINT) AS n FROM ({_PLACED})")
def attributes_by_place(spark, sf_dir):
    """Attributes by their place, from either end, and the place of a name."""
    lines = twin.customer_forest(spark, sf_dir).filter("name = 'line'")
    return lines.agg(F.sum(attrs.attribute_at(1)["value"].cast("long")).alias("qty"), F.sum(attrs.attribute_at(-1)["value"].cast("long")).alias("supp"), F.count_if((attrs.index_of("qty") == 1) & (attrs.index_of("none") == -1)).alias("n"))


@query(f"SELECT elem, CAST(sum(n) AS BIGINT) AS n FROM (SELECT 'nation' AS elem, 1 AS n FROM customer UNION ALL SELECT 'customer', 2 FROM customer UNION ALL SELECT 'order', 3 FROM ({_ORDERS})) GROUP BY elem")
def attribute_edits(spark, sf_dir):
    """Set (new and in place), remove and clear."""
    forest = attrs.set_attribute(twin.customer_forest(spark, sf_dir), F.col("name") == "order", "mark", "x")
    forest = attrs.remove_attribute(attrs.set_attribute(forest, F.col("name") == "order", "key", "0"), F.col("name") == "order", "status")
    return attrs.exploded(attrs.clear_attributes(forest, F.col("name") == "line")).groupBy("elem").agg(F.count(F.lit(1)).alias("n"))


# -- edits -----------------------------------------------------------------------------


@query(f"SELECT CASE WHEN name = 'line' THEN 'item' ELSE name END AS name, CAST(count(*) AS BIGINT) AS n FROM ({_ALL}) GROUP BY 1")
def renamed_lines(spark, sf_dir):
    return _by_name(mutate.rename(twin.customer_forest(spark, sf_dir), F.col("name") == "line", "item"))


@query(f"SELECT o_orderkey AS order_key, CAST(1 + (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS BIGINT) AS n FROM ({_ORDERS})")
def cloned_orders(spark, sf_dir):
    """Subtrees as documents of their own."""
    forest = customers(spark, sf_dir)
    return mutate.clone(forest, forest.filter("name = 'order'"), attr("key", "long")).groupBy(F.col("doc_id").alias("order_key")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT name, CAST(count(*) AS BIGINT) AS n FROM (SELECT 'nation' AS name FROM customer UNION ALL SELECT 'customer' FROM customer UNION ALL SELECT 'order' FROM ({_ORDERS}) UNION ALL SELECT CASE WHEN l_returnflag = 'R' THEN 'back' ELSE 'line' END FROM ({_PLACED})) GROUP BY 1")
def replaced_lines(spark, sf_dir):
    forest = customers(spark, sf_dir)
    return _by_name(mutate.replace(forest, css.select(forest, "line[flag=R]"), "<back/>"))


@query(f"SELECT name, CAST(count(*) AS BIGINT) AS n FROM (SELECT 'nation' AS name FROM customer UNION ALL SELECT 'customer' FROM customer UNION ALL SELECT 'order' FROM ({_ORDERS}) UNION ALL SELECT '#text' FROM ({_ORDERS}) WHERE o_orderstatus = 'P' UNION ALL SELECT 'line' FROM ({_PLACED}) WHERE o_orderstatus <> 'P') GROUP BY 1")
def emptied_orders(spark, sf_dir):
    """Content replaced by a text."""
    forest = customers(spark, sf_dir)
    return _by_name(mutate.set_content(forest, css.select(forest, "order[status=P]"), text="gone"))


@query(f"SELECT c_custkey AS customer, CAST(sum(opos + p) AS BIGINT) AS places FROM (SELECT *, count(*) FILTER (o_orderstatus = 'P') OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM ({_ORDERS})) GROUP BY 1")
def notes_before_orders(spark, sf_dir):
    """Insertion before nodes moves what follows."""
    forest = customers(spark, sf_dir)
    done = mutate.insert(forest, css.select(forest, "order[status=P]"), "<note/>", "before")
    return done.filter("name = 'order'").groupBy(F.col("doc_id").alias("customer")).agg(F.sum((F.col("ord") + 1).cast("long")).alias("places"))


@query(f"SELECT CAST(sum(opos - 1) AS BIGINT) AS before, CAST(count(*) AS BIGINT) AS n FROM ({_ORDERS})")
def places_in_children(spark, sf_dir):
    """Places among element children."""
    orders = positions.child_index(twin.customer_forest(spark, sf_dir), only_elements=True).filter("name = 'order'")
    return orders.agg(F.sum(F.col("child_index").cast("long")).alias("before"), F.count(F.lit(1)).alias("n"))


@query(f"SELECT o_orderstatus AS state, CAST(count(*) AS BIGINT) AS n FROM ({_ORDERS}) GROUP BY 1")
def renamed_attributes(spark, sf_dir):
    done = attrs.rename_attribute(twin.customer_forest(spark, sf_dir), F.col("name") == "order", "status", "state")
    return done.filter(F.col("name") == "order").groupBy(attr("state").alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT o_orderkey AS order_key, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END, o_orderkey) AS BIGINT) AS place, CAST((SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS BIGINT) AS n_lines FROM ({_ORDERS})")
def moved_orders(spark, sf_dir):
    """Subtrees moved to the end of their customer."""
    forest = twin.customer_forest(spark, sf_dir).select(*_TREE, attr("key", "long").alias("key"), attr("status").alias("status"))
    done = mutate.move(forest, F.when((F.col("name") == "order") & (F.col("status") == "P"), F.col("parent")))
    return done.filter("name = 'order'").select(F.col("key").alias("order_key"), (F.col("ord") + 1).cast("long").alias("place"), long("n_children", "n_lines"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS nation, 'urn:n' || n_nationkey AS uri, 'urn:d' AS plain FROM nation")
def namespaces_of_inserted(spark, sf_dir):
    """An inserted fragment takes the prefixes of its place."""
    n = table(spark, sf_dir, "nation")
    doc = F.concat(F.lit('<r xmlns="urn:d" xmlns:p="urn:n'), F.col("n_nationkey").cast("string"), F.lit('"><q/></r>'))
    forest = shred(n.select("n_nationkey", doc.alias("text")), "n_nationkey", "text")
    done = mutate.insert(forest, forest.filter("name = 'q'"), "<p:x/><y/>", "after")
    return done.groupBy(F.col("doc_id").alias("nation")).agg(F.max(F.when(F.col("name") == "p:x", F.col("ns_uri"))).alias("uri"), F.max(F.when(F.col("name") == "y", F.col("ns_uri"))).alias("plain"))


@query("SELECT CAST(p_partkey AS BIGINT) AS part, substr(p_type, 1, 3) AS head, substr(p_type, 4) AS tail FROM part")
def split_texts(spark, sf_dir):
    """Texts cut in two around an element."""
    p = table(spark, sf_dir, "part")
    forest = shred(p.select("p_partkey", F.concat(F.lit("<t>"), text.escape_text(F.col("p_type")), F.lit("</t>")).alias("text")), "p_partkey", "text")
    done = mutate.split_text(forest, forest.filter("node_type = 3"), 3, "<b/>")
    return done.groupBy(F.col("doc_id").alias("part")).agg(F.max(F.when(F.col("ord") == 0, F.col("data"))).alias("head"), F.max(F.when(F.col("ord") == 2, F.col("data"))).alias("tail"))


@query(f"SELECT o_orderkey AS order_key, '1(nation)/1(customer)/' || opos || '(order)' AS typed, '1/1/' || opos || '/@key' AS key_path FROM ({_ORDERS})")
def typed_paths(spark, sf_dir):
    """Paths with names, and to attributes."""
    orders = twin.customer_forest(spark, sf_dir).filter("name = 'order'")
    return orders.select(attr("key", "long").alias("order_key"), axes.node_path(typed=True).alias("typed"), axes.node_path(attribute="key").alias("key_path"))


@query(f"SELECT elem, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(['key', 'status', 'priority']) AS elem FROM ({_ORDERS}) UNION ALL SELECT unnest(['n', 'qty', 'cents', 'flag', 'part', 'supp']) FROM ({_PLACED})) GROUP BY 1")
def attributes_below_customers(spark, sf_dir):
    """The attributes on the descendant axis."""
    forest = customers(spark, sf_dir)
    return axes.descendant_attributes(forest, forest.filter("name = 'customer'")).groupBy(F.col("name").alias("elem")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS nation, '/d/section/section/p' AS deepest, CAST(3 AS BIGINT) AS n_sections FROM nation")
def nested_sections(spark, sf_dir):
    """Headings to nested sections."""
    n = table(spark, sf_dir, "nation")
    forest = shred(n.select("n_nationkey", F.concat(F.lit("<d><p/><h1>"), "n_name", F.lit("</h1><p/><h2/><p/><h1/></d>")).alias("text")), "n_nationkey", "text")
    done = mutate.sections(forest).groupBy(F.col("doc_id").alias("nation"))
    return done.agg(F.max_by(F.when(F.col("name") == "p", F.col("tag_path")), F.when(F.col("name") == "p", F.col("depth"))).alias("deepest"), F.count_if(F.col("name") == "section").alias("n_sections"))
