"""Every registered query of the tree engine against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

import sylva.streaming.pipelines as pipelines
from sylva.plans import catalog, proofs  # noqa: F401 (proofs adds to the catalog)

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query(spark, sql, name):
    got = catalog.QUERIES[name](spark, SF)
    rows = sorted(str([r[c] for c in sorted(got.columns)]) for r in got.collect())
    if name not in catalog.ORACLE_SQL:
        assert rows
        return
    want = sql.sql(catalog.ORACLE_SQL[name])
    at = [want.columns.index(c) for c in sorted(want.columns)]
    assert sorted(want.columns) == sorted(got.columns)
    assert rows == sorted(str([r[i] for i in at]) for r in want.fetchall())


def test_entry_without_training_subpackage(tmp_path):
    """The entry module works when the training operators are not there."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/sylva", tmp_path / "sylva", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'links_per_page' in e.queries() and not any(q.startswith('op') and q[2].isdigit() or q == 'pipeline' for q in e.queries()); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_stream_of_documents(spark, tmp_path):
    docs = spark.createDataFrame([(1, "<a><b/></a>"), (2, "<a>")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    nodes = pipelines.stream_documents(spark, str(tmp_path / "in"))
    q = pipelines.write_forest(nodes, str(tmp_path / "out"), str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).filter("node_type = 1").count() == 2


def test_document_in_pieces(spark, tmp_path):
    pieces = [(1, 0, "<a><b>te"), (1, 1, "xt</b><c"), (1, 2, "/><d>"), (2, 0, "<x></x>")]
    spark.createDataFrame(pieces, "doc_id long, seq long, piece string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, seq long, piece string").parquet(str(tmp_path / "in"))
    q = pipelines.open_tags(stream).writeStream.outputMode("update").format("memory").queryName("open_tags").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.sql("SELECT * FROM open_tags").collect()} == {(1, 4, "a/d"), (2, 1, "")}


def test_windows_as_streams(spark, tmp_path):
    events = spark.readStream.schema(pipelines.EVENTS).option("pathGlobFilter", "events.parquet").parquet(SF)
    q = pipelines.tumbling(events).writeStream.outputMode("complete").format("memory").queryName("by_hour").trigger(availableNow=True).start()
    q.awaitTermination(120)
    at_rest = catalog.QUERIES["events_by_hour"](spark, SF)
    assert spark.sql("SELECT sum(n) FROM by_hour").first()[0] == at_rest.agg({"n": "sum"}).first()[0]
