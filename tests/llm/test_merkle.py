import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from quarrystone.llm import merkle

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(leaves):
    """The root, and of each leaf its siblings level by level as (left, right)."""
    paths, where, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        for k, i in enumerate(where):
            run = i // 8 * 8
            paths[k].append((nodes[run:i], nodes[i + 1 : run + 8]))
            where[k] = i // 8
        nodes = [h(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
    return nodes[0], paths


def brute(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    kept = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r))) for x in langs}
    trees = {x: tree([leaf(*r) for r in rs]) for x, rs in kept.items()}
    root, over = tree([trees[x][0] for x in langs])
    out = []
    for x, up in zip(langs, over, strict=True):
        for r, own in zip(kept[x], trees[x][1], strict=True):
            path = own + up
            changed = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            now = leaf(*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]) if changed else r[4])
            for a, b in path:
                now = h(*a, now, *b)
            out.append((r[0], leaf(*r), trees[x][0], root, h(*(s for a, b in path for s in a + b)), now, now == root))
    return sorted(out, key=repr)


def rows_of(n, langs):
    return [(i, None if i % 7 == 0 else f"s{i % 3}", langs[i % len(langs)], None if i % 5 == 0 else i, ["Ünï Text", "lower", "", None, "ÀB " * 9][i % 5]) for i in range(n)]


@pytest.mark.parametrize(("n", "langs"), [(1, ["a"]), (2, ["a", None]), (8, ["a"]), (9, ["a"]), (65, ["a"]), (130, ["é", "z", None, ""]), (513, ["a"]), (700, ["q"] * 9 + ["a"]), (120, [f"l{i}" for i in range(40)])])
def test_against_the_definition(spark, n, langs):
    rows = rows_of(n, langs)
    found = merkle.manifest(spark.createDataFrame(rows, COLUMNS)).collect()
    assert sorted(map(tuple, found), key=repr) == brute(rows)


def test_several_rounds_of_blocks(spark):
    """Trees of 4,097 leaves and more go through a second round with a last run of one."""
    rows = rows_of(9000, ["a", "a", "b"])
    found = merkle.manifest(spark.createDataFrame(rows, COLUMNS).repartition(7)).collect()
    assert sorted(map(tuple, found), key=repr) == brute(rows)


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    rows = [(3, "s", "a", 1, "One"), (3, "s", "a", 1, "One"), (3, "s", "a", 2, "Two"), (None, "s", "a", 1, "X"), (None, None, None, None, None), (1, "s", None, 0, "")]
    docs = spark.createDataFrame(rows, COLUMNS)
    for name in ("pos", "total", "root", "items", "path", "leaf", "__part", "all"):
        docs = docs.withColumn(name, F.lit(1))
    assert sorted(map(tuple, merkle.manifest(docs).collect()), key=repr) == brute(rows)


def test_another_copy_and_an_empty_table(spark):
    docs = spark.createDataFrame(rows_of(40, ["a", "b"]), COLUMNS)
    out = merkle.manifest(docs, F.when(F.col("doc_id") == 11, F.lit("forged")))
    assert [r["doc_id"] for r in out.where("not verified").collect()] == [11]
    assert merkle.manifest(docs.limit(0)).count() == 0


def test_no_python_on_the_path(spark):
    docs = spark.createDataFrame(rows_of(20, ["a"]), COLUMNS)
    plan = merkle.manifest(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
