import random
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrystone.llm import neardup


def shingles(text):
    words = text.split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def likeness(x, y):
    """Probability Jaccard similarity by its definition, over all pairs of runs."""
    shared = [d for d in x if d in y]
    if not shared:
        return 0.0
    runs = list(x | y)
    a, b = (np.array([c[r] for r in runs], float) for c in (x, y))
    largest = [np.maximum(a / x[d], b / y[d]).sum() for d in shared]
    return sum(1 / m for m in largest)


def brute(rows):
    """class_id by chains of pairs with a similarity of 0.8 or more; empty texts are copies of each other."""
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = {i: shingles(t or "") for i, t in rows}
    for (a, ta), (b, tb) in combinations(rows, 2):
        same = (ta or "") == (tb or "")
        if same or likeness(sets[a], sets[b]) >= 0.8 - 1e-12:
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i, _ in rows}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    rows = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([20, 60, 200]))]
        rows.append(base)
        for _ in range(rng.randrange(8)):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(copy)
    rows += [[word() for _ in range(n)] for n in (1, 3, 4, 5, 5000)]
    rng.shuffle(rows)
    return [(i, " ".join(r)) for i, r in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_are_those_of_all_pairs(spark, seed):
    rows = [*corpus(seed), (900, ""), (901, None), (902, "a b c"), (903, "a b c")]
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["class_id"] for r in found.collect()} == brute(rows)


def test_a_large_group_that_hangs_on_one_base(spark):
    """Copies with one edit each are linked to the base, and mostly not to each other."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(60)]
    rows = [(500, " ".join(base))]
    for i in range(150):
        copy = list(base)
        copy[rng.randrange(5, 55)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["class_id"] for r in found.collect()} == brute(rows)


def test_similarities_are_those_of_the_definition():
    rng = random.Random(4)
    pairs = []
    for _ in range(200):
        words = [f"s{rng.randrange(4)}" for _ in range(rng.randrange(40))]
        other = [w for w in words if rng.random() > 0.1] * rng.randrange(1, 3) + [f"s{rng.randrange(4)}" for _ in range(rng.randrange(4))]
        pairs.append((" ".join(words), " ".join(other)))
    got = neardup.similarities(pa.array([a for a, _ in pairs]), pa.array([b for _, b in pairs]))
    assert np.allclose(got, [likeness(shingles(a), shingles(b)) for a, b in pairs], atol=1e-9)
    assert len(set(got.round(3))) > 50


def test_repeated_runs_weigh_as_often_as_they_are_repeated(spark):
    """Weighted similarities of 0.8 to 0.85 between texts that repeat half of their runs: no signature rules them out. Of sets they are below 0.7."""
    rng = random.Random(3)
    rows = []
    for i in range(30):
        base, often = [f"p{i}w{j}" for j in range(60)], [f"p{i}r{j}" for j in range(40)] * 6
        more = [f"p{i}x{j}" for j in range(rng.randrange(52, 66))]
        rows += [(2 * i, " ".join(base + often)), (2 * i + 1, " ".join(base + often + more))]
        a, b = shingles(rows[-2][1]), shingles(rows[-1][1])
        assert 0.8 <= likeness(a, b) < 0.86 and len(a.keys() & b.keys()) / len(a.keys() | b.keys()) < 0.7
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sig = docs.withColumn("tag", F.lit(0).cast("long")).mapInArrow(neardup._signatures, neardup.SIG_SCHEMA)
    x, y = (neardup.durable(sig.where(f"doc_id % 2 = {k}")).alias(n) for k, n in enumerate("xy"))
    pairs = x.join(y, F.col("x.doc_id") + 1 == F.col("y.doc_id")).where(F.arrays_overlap("x.bands", "y.bands"))
    assert pairs.where(neardup._close("x.bits", "y.bits")).count() == pairs.count() == 30
    found = neardup.near_duplicates(docs)
    assert {r["doc_id"]: r["class_id"] for r in found.collect()} == {i: i - i % 2 for i, _ in rows}


def test_texts_that_repeat_shared_runs_very_unequally_are_apart(spark):
    base = [f"w{j}" for j in range(180)]
    rows = [(0, " ".join(base)), (1, " ".join(base[:60] + base[60:120] * 300 + base[120:]))]
    assert likeness(*(shingles(t) for _, t in rows)) < 0.5
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["class_id"] for r in found.collect()} == {0: 0, 1: 1}


def test_a_bucket_of_many_classes_is_compared_in_tiles(spark, monkeypatch):
    """Texts of one template, some of them linked past the centres of their buckets: tiles of 8 texts give the classes of all pairs."""
    monkeypatch.setattr(neardup, "TILE", 8)
    rng = random.Random(9)
    rows = []
    for i in range(40):
        own = [f"o{i}n{j}" for j in range(30)]
        rows.append([f"t{j}" for j in range(110)] + own)
        copy = list(rows[-1])
        copy[rng.randrange(112, 138)] = f"y{i}"
        rows.append(copy)
    rows = [(i, " ".join(r)) for i, r in enumerate(rows)]
    want = brute(rows)
    assert len(set(want.values())) == 40
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["class_id"] for r in found.collect()} == want


def test_recall_by_similarity(spark):
    """Pairs in three bands of similarity: what share of them is linked."""
    rng = random.Random(11)
    rows, level = [], {}
    while len(level) < 240:
        i = len(level)
        words = [f"q{i}w{j}" for j in range(120)] + [f"q{i}v{j}" for j in range(10)] * rng.randrange(1, 6)
        copy = list(words)
        for _ in range(rng.randrange(1, 5)):
            copy[rng.randrange(len(copy))] = f"q{i}z{rng.randrange(1000)}"
        s = likeness(shingles(" ".join(words)), shingles(" ".join(copy)))
        if s >= 0.8:
            level[i] = 0.8 if s < 0.85 else 0.85 if s < 0.9 else 0.9
            rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy))]
    found = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    of = Counter(level.values())
    met = Counter(x for i, x in level.items() if found[2 * i + 1] == 2 * i)
    assert len(of) == 3 and min(of.values()) >= 20
    assert all(met[x] == of[x] for x in of), {x: met[x] / of[x] for x in of}


def test_one_of_each_keeps_columns_and_least_id(spark):
    text = " ".join(f"t{i}" for i in range(50))
    rows = [(3, text, "x", 9), (1, text, "y", 8), (1, text, "y", 8), (2, "other words here", None, 7), (None, text, "z", 6), (None, "alone", "z", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, class_id int")
    out = neardup.one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted(out.collect(), key=repr) == sorted([(1, text, "y", 8), (2, "other words here", None, 7), (None, "alone", "z", 5)], key=repr)


def test_empty_table(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(1)
    both = rng.integers(1, 2**63, 800).astype(np.uint64)
    a, b = both[:700], both[100:]
    weight = np.ones(700)
    sig = neardup.prob_minhash(np.repeat([0, 1], 700), np.concatenate((a, b)), np.concatenate((weight, weight)), 2, registers=2048)
    assert abs((sig[0] == sig[1]).mean() - 600 / 800) < 0.05


def test_heavier_elements_win_more_registers():
    h = np.array([11, 22], np.uint64)
    sig = neardup.prob_minhash(np.zeros(2, int), h, np.array([3.0, 1.0]), 1, registers=4096)
    assert abs((sig == 11).mean() - 0.75) < 0.04


def test_lower_thresholds_are_refused(spark):
    with pytest.raises(ValueError):
        neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string"), 0.5)
