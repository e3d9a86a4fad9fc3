"""page_titles on pages that the smallest tables do not hold, beside its SQL."""

import duckdb

from sylva.plans import catalog
from sylva.sources.options import ShredOptions
from sylva.sources.shred import Shredder

PAGES = [
    "<html><title>a &quot;b&quot; &amp; &lt;c> &#65; &copy; &AMP; &amp;amp;</title></html>", "<title>x&y&amp;z</title>", "<title></title><title>second</title>", "<p>no title</p>", None, "",
    '<title lang="en">p</title><title>q</title>', "<title>a<b>c</title><title>d</title>", "<title>first</title><svg><title>second</title></svg>",
]


def test_titles(spark, tmp_path):
    spark.createDataFrame(list(enumerate(PAGES)), "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(catalog.ORACLE_SQL["page_titles"]).fetchall()
    assert sorted(tuple(r) for r in catalog.QUERIES["page_titles"](spark, str(tmp_path)).collect()) == sorted(want)


def test_references_are_replaced_by_default():
    data = lambda html, **options: Shredder(ShredOptions(mode="html", **options)).shred(html)["data"]
    assert "a&b&\"" in data("<title>a&b&amp;&quot;</title>") and "&\"A" in data("<p>&amp;&quot;&#65;</p>")
    assert "&&quot;&#65;" in data("<p>&amp;&quot;&#65;</p>", references=frozenset({"amp"}))
