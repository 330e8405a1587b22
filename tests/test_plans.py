import random
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quarrystone.plans import ranking, screen
from quarrystone.plans.components import changed_components, connected_components, updated_components
from quarrystone.plans.durable import durable, shared_folder
from quarrystone.plans.forest import best_forest, last_step_that_fits
from quarrystone.plans.ranking import Order, ntiles

REPO = Path(__file__).resolve().parents[1]


def union_find(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def chain(n):
    order = list(range(n))
    random.Random(1).shuffle(order)
    return list(zip(order, order[1:], strict=False))


@pytest.mark.parametrize(
    "edges",
    [
        chain(120),
        [(0, i) for i in range(1, 300)] + [(500, 501), (501, 501), (None, 7), (501, 500)],
        [(random.Random(2 + i).randrange(200), random.Random(900 + i).randrange(200)) for i in range(150)],
        [],
    ],
    ids=["chain", "star", "random", "empty"],
)
def test_components(spark, edges):
    out = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["vertex"]: r["component"] for r in out.collect()} == union_find(edges)


def test_components_follow_changes_of_edges(spark):
    """After each batch of added and removed edges the labels are those of a full run, and untouched components are not rewritten."""
    rng = random.Random(1)
    frame = lambda e: spark.createDataFrame(sorted(e), "a long, b long")
    pair = lambda: tuple(sorted(rng.sample(range(80), 2)))
    edges = {pair() for _ in range(35)} | {(500, 501), (501, 502)}
    labels = durable(connected_components(frame(edges)))
    for i in range(2):
        removed = set(rng.sample(sorted(edges - {(500, 501), (501, 502)}), 9))
        added = {pair() for _ in range(8)} | {(200 + i, 300)} - edges
        before, edges = dict(map(tuple, labels.collect())), edges - removed | added
        changed = dict(map(tuple, changed_components(labels, frame(edges), frame(added), frame(removed)).collect()))
        labels = durable(updated_components(labels, frame(edges), frame(added), frame(removed)))
        got, full = dict(map(tuple, labels.collect())), union_find(edges)
        assert {v: c for v, c in got.items() if v in full} == full and all(c == v for v, c in got.items() if v not in full)
        assert changed == {v: c for v, c in got.items() if before.get(v) != c} and not changed.keys() & {500, 501, 502}


def test_best_forest_is_kruskals(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(60), rng.randrange(60), rng.randrange(4)) for _ in range(300)] + [(100, 100, 0), (None, 5, 0), (1, 2, 0), (1, 2, 0), (200, 201, 3)]
    found = best_forest(spark.createDataFrame(edges, "a long, b long, w int"), "a", "b", [F.col("w")], ["w"]).collect()
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    want = []
    for a, b, w in sorted({e for e in edges if None not in e}, key=lambda e: (e[2], e[0], e[1])):
        if find(a) != find(b):
            root[find(a)] = find(b)
            want.append((a, b, w))
    assert sorted(map(tuple, found)) == sorted(want)
    assert best_forest(spark.createDataFrame([], "a long, b long, w int"), "a", "b", [F.col("w")]).count() == 0


def test_the_last_step_that_fits(spark):
    """A path whose steps come one by one, a star that never fits from its third step on, and a group with one step too large at once."""
    rows = [("path", i, i + 1, i) for i in range(200)] + [("star", 1000, 1001 + i, 7 * i) for i in range(50)] + [("once", 2000, 2001 + i, 1) for i in range(9)]
    forest = spark.createDataFrame(rows, "g string, a long, b long, s long")
    for limit, want in ((3, {"path": 1, "star": 7}), (10, {"path": 8, "star": 56, "once": 1})):
        assert dict(map(tuple, last_step_that_fits(forest, "g", "a", "b", ["s"], limit).collect())) == want


def test_components_of_words(spark):
    out = connected_components(spark.createDataFrame([("b", "c"), ("c", "a"), ("x", "y")], "s string, t string"), "s", "t")
    assert {tuple(r) for r in out.collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")}


def test_components_give_up(spark):
    with pytest.raises(RuntimeError):
        connected_components(spark.createDataFrame(chain(300), "a long, b long"), max_rounds=1)


def test_durable_keeps_rows_and_schema(spark):
    df = spark.createDataFrame([(1, "a", [1.5]), (None, None, None), (1, "a", [1.5])], "k long, s string, x array<double>")
    kept = durable(df)
    assert kept.dtypes == df.dtypes and sorted(kept.collect(), key=repr) == sorted(df.collect(), key=repr)
    assert shared_folder(spark) == shared_folder(spark)


def tiles(values, n):
    """NTILE over sorted keys: the first tiles are larger by one."""
    size, more = divmod(len(values), n)
    out, at = {}, 0
    for t in range(n):
        for v in values[at : at + size + (t < more)]:
            out[v] = t + 1
        at += size + (t < more)
    return out


@pytest.mark.parametrize(("count", "interval"), [(1, 1), (3, 1), (5, 50_000), (23, 2)])
def test_ntiles(spark, monkeypatch, count, interval):
    monkeypatch.setattr(ranking, "INTERVAL", interval)
    rng = random.Random(count)
    rows = [(i, rng.choice([None, 1, 2, 3])) for i in range(count)]
    out = ntiles(spark.createDataFrame(rows, "id long, x int"), "id", {"up": ([Order("x", "asc_nulls_last")], 5), "down": ([Order("x", "desc_nulls_first")], 2)})
    got = {r["id"]: (r["up"], r["down"]) for r in out.collect()}
    up = tiles([i for i, x in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0]))], 5)
    down = tiles([i for i, x in sorted(rows, key=lambda r: (r[1] is not None, -(r[1] or 0), r[0]))], 2)
    assert got == {i: (up[i], down[i]) for i, _ in rows}


def test_tiles_where_one_value_has_most_rows(spark, monkeypatch):
    """Nine tenths of the rows tie, so every border lies among them; strings, nulls and NaN, with many cuts."""
    monkeypatch.setattr(ranking, "INTERVAL", 8)
    rng = random.Random(4)
    rows = [(f"k{i:05}", 7 if rng.random() < 0.9 else rng.randrange(100), rng.choice(["a", "b", None]), rng.choice([float("nan"), 1.5, None, -2.0])) for i in range(3000)]
    rng.shuffle(rows)
    out = ntiles(spark.createDataFrame(rows, "id string, x int, s string, f double").repartition(7), "id", {
        "ten": ([Order("x")], 10), "words": ([Order("s", "asc_nulls_first"), Order("x", "desc_nulls_last")], 7), "low": ([Order("f", "desc_nulls_first")], 3), "all": ([Order("x")], 1)})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    nan = lambda f: f is not None and f != f
    want = {
        "ten": tiles([r[0] for r in sorted(rows, key=lambda r: (r[1], r[0]))], 10), "all": {r[0]: 1 for r in rows},
        "words": tiles([r[0] for r in sorted(rows, key=lambda r: (r[2] is not None, r[2] or "", -r[1], r[0]))], 7),
        "low": tiles([r[0] for r in sorted(rows, key=lambda r: (r[3] is not None, not nan(r[3]), 0 if r[3] is None or nan(r[3]) else -r[3], r[0]))], 3),
    }
    got = out.collect()
    for name, one in want.items():
        assert {r["id"]: r[name] for r in got} == one, name


def test_descending_words_are_refused(spark):
    with pytest.raises(ValueError):
        ntiles(spark.createDataFrame([("a", "b")], "id string, s string"), "id", {"x": ([Order("s", "desc_nulls_last")], 2)})


def test_orders_are_checked():
    with pytest.raises(ValueError):
        Order("x", "sideways")


@pytest.mark.parametrize("bits", [2**23, 64])
def test_rows_of_repeated_keys_are_marked(spark, monkeypatch, bits):
    """A third of the rows have null keys, a third one key; with a filter that is full everything is a candidate, and the marks are the same."""
    monkeypatch.setattr(screen, "BITS", bits)
    monkeypatch.setattr(screen, "HEAVY", 4)
    rng = random.Random(bits)
    rows = [(i, rng.choice([None, 7, rng.randrange(60)]), rng.choice(["a", None, f"s{rng.randrange(40)}"]), rng.choice([1, 1, 1, 2, None])) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, k int, s string, v int").repartition(6)
    out = screen.marked(df, {
        "twice": screen.Screen(("k", "s"), F.count("*") > 1), "mixed": screen.Screen(("s",), F.coalesce(F.min("v") != F.max("v"), F.lit(False))), "never": screen.Screen(("id",), F.count("*") > 1)})
    pairs, values = Counter((r[1], r[2]) for r in rows), {}
    for r in rows:
        values.setdefault(r[2], set()).update({r[3]} - {None})
    got = {r["id"]: (r["twice"], r["mixed"], r["never"]) for r in out.collect()}
    assert got == {i: (pairs[k, s] > 1, len(values[s]) > 1, False) for i, k, s, _ in rows}
    assert out.columns == ["id", "k", "s", "v", "twice", "mixed", "never"]
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    assert screen.marked(df.limit(0), {"twice": screen.Screen(("k",), F.count("*") > 1)}).count() == 0


def test_the_entry_imports_without_the_corpus_operators(tmp_path):
    """In a copy without them, the other queries are still there."""
    code = (
        "import sys, importlib.abc\n"
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('quarrystone.llm'):\n"
        "            raise ModuleNotFoundError(name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        f"sys.path.insert(0, {str(REPO)!r})\n"
        "import __spark_entry__ as e\n"
        "assert 'customer_metrics' in e.queries() and 'pipeline' not in e.queries()\n"
        "assert not [n for n in e.queries() if n.startswith('op') and n[2].isdigit()]\n"
        "assert set(e.oracle_sql()) <= set(e.queries())\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)


def test_nothing_else_imports_the_corpus_operators():
    for p in (REPO / "quarrystone").rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text(), p
