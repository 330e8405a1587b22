"""Every query that has SQL against DuckDB over the smallest tables; the others give rows."""

import datetime as dt
import decimal
import math
from pathlib import Path

import duckdb
import pytest

from quarrystone import source_queries, view_queries  # noqa: F401 - add their queries
from quarrystone.queries import ORACLES, QUERIES

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for p in FOLDER.glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v.replace(tzinfo=None) if isinstance(v, dt.datetime) else v


def rows(found, columns, order):
    return sorted(([plain(r[columns.index(c)]) for c in order] for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    out = QUERIES[name](spark, str(FOLDER))
    want = duck.sql(ORACLES[name])
    order = sorted(out.columns)
    assert order == sorted(want.columns)
    assert rows(out.collect(), out.columns, order) == rows(want.fetchall(), want.columns, order)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, str(FOLDER)).count() > 0


def test_every_turn_is_routed(spark, tmp_path):
    """The test tables have no turn with a routing word; these have."""
    texts = ["the timeline", "The Segment, a linked merge, the quality, what changed, churn", "churn without customer", "the weather", None]
    turns = spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(texts)], "conv_id long, turn int, role string, text string")
    turns.write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r["turn"]: r["tools"] for r in QUERIES["routed_turns"](spark, str(tmp_path)).collect()}
    name = lambda *ts: ",".join(f"get_customer_{t}" for t in ts)
    assert found == {0: name("profile", "timeline"), 1: name("profile", "segments", "identities", "quality", "timeline", "metrics"), 2: "", 3: name("profile"), 4: ""}
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    assert dict(con.sql(f"select turn, tools from ({ORACLES['routed_turns']})").fetchall()) == found


def test_large_clusters_are_cut_only_where_their_sql_cuts_them(spark, tmp_path):
    """The test tables have no cluster of more than 50 records; these have one of 70 and a pair that is parted."""
    rows = [(i, f"Customer#{i}", 3, "BUILDING", 1000.0 + i % 2) for i in range(70)] + [(100, "a", 7, "MACHINERY", 2000.0), (101, "b", 8, "MACHINERY", 2001.0)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_mktsegment string, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, "s", 20, 5.0)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    for t in ("customer", "supplier"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("identity_eval", "guarded_clusters", "review_queue"):
        found = QUERIES[name](spark, str(tmp_path))
        want = con.sql(f"select {', '.join(found.columns)} from ({ORACLES[name]})").fetchall()
        assert sorted(map(tuple, found.collect())) == sorted(want), name


def test_every_twentieth_vector_is_a_query(spark, duck):
    asked = {r[0] for r in duck.sql("select vec_id from embeddings where vec_id % 20 = 0").fetchall()}
    found = QUERIES["vector_topk_each"](spark, str(FOLDER)).collect()
    assert len(asked) > 1 and {r["query_id"] for r in found} == asked and len(found) == 10 * len(asked)


def test_chunks_of_marked_texts_are_those_of_their_sql(spark, tmp_path):
    """The test tables have few headings and paragraphs; these have."""
    para = lambda *ns: "\n\n".join("wörd " * n for n in ns)
    texts = [
        "intro\n\n## One\nfirst\n### Two\n" + para(80, 90, 20, 300, 5, 5, 170, 10), "## A\n\n\n## B\n## C \r\nx\r\ny\r\n\r\nz", "#### no\n##none\n" + para(*[3] * 200),
        "", None, " \n ", "plain", para(179, 1), para(180), para(181), "# top\n### x ## y\n\n\n\n" + para(100, 100) + "\n\n\n" + para(100),
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["chunk_text"](spark, str(tmp_path)).select("doc_id", "chunk_no", "section", "content").collect()
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(f"select doc_id, chunk_no, section, content from ({ORACLES['chunk_text']})").fetchall()
    assert sorted(map(tuple, found)) == sorted(want) and len(want) > 20
