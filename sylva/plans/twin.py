"""Documents built from the relational tables, so that tree answers have a plain SQL form.

One document per customer, small enough for any number of them in parallel:
``<nation name><customer key name seg><order key status priority><line n qty price flag part supp/>..</order>..</customer></nation>``
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.functions.text import escape_attribute
from sylva.sources.shred import shred

#: What orders the lines of an order; line numbers repeat in the data.  Lines that are equal in all of these have the same text.
LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")


def _attr(name: str, value) -> F.Column:
    return F.concat(F.lit(f' {name}="'), escape_attribute(value.cast("string")), F.lit('"'))


def _parts(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def _bare(*values) -> F.Column:
    """Attribute values with a quote after each, which no escaped value holds."""
    return F.concat(*[x for v in values for x in (v.cast("string"), F.lit('"'))])


def _line() -> F.Column:
    return _bare(F.col("l_linenumber"), F.col("l_quantity").cast("int"), F.round(F.col("l_extendedprice") * 100).cast("long"), escape_attribute(F.col("l_returnflag").cast("string")), F.col("l_partkey"), F.col("l_suppkey"))


def customer_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text), built bottom-up: lines by order, orders by customer.

    Lines travel twice, to their order and to their customer, and as bare values; the text is made in the end.  They are
    dealt before they are gathered, since gathering before sends as much and sorts twice, and to all tasks, since small
    joins leave few partitions and shredding is the dear part.
    """
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    parts = _parts(spark)
    gathered = F.collect_list(F.struct(*LINE_ORDER, _line().alias("bare")))
    lines = t("lineitem").select("l_orderkey", *LINE_ORDER).repartition(parts, "l_orderkey").groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(gathered), lambda x: x["bare"]), "").alias("lines"))
    orders = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority").repartition(parts, "o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    orders = orders.select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority", "lines").repartition(parts, "o_custkey")
    tags = F.regexp_replace(F.coalesce("lines", F.lit("")), '([^"]*)"' * 6, '<line n="$1" qty="$2" cents="$3" flag="$4" part="$5" supp="$6"/>')
    order = F.concat(F.lit("<order"), _attr("key", F.col("o_orderkey")), _attr("status", F.col("o_orderstatus")), _attr("priority", F.col("o_orderpriority")), F.lit(">"), tags, F.lit("</order>"))
    by_customer = orders.groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", order.alias("xml")))), lambda x: x["xml"]), "").alias("orders"))
    customers = t("customer").join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_mktsegment", "n_name").repartition(parts, "c_custkey")
    customers = customers.join(by_customer, F.col("c_custkey") == F.col("o_custkey"), "left")
    text = F.concat(
        F.lit("<nation"), _attr("name", F.col("n_name")), F.lit("><customer"), _attr("key", F.col("c_custkey")), _attr("seg", F.col("c_mktsegment")), F.lit(">"),
        F.coalesce("orders", F.lit("")), F.lit("</customer></nation>"),
    )
    return customers.select(F.col("c_custkey").cast("long").alias("doc_id"), text.alias("text"))


def customer_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trees."""
    return shred(customer_documents(spark, sf_dir))
