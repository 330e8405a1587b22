import random
import zlib

import numpy as np
import pyarrow as pa

from quarrystone.llm import quality


def corpus(n, seed=1):
    """Prose and shouted junk, by turns."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.6
        words = [f"{'abcdefg'[rng.randrange(7)]}{'lmnop'[rng.randrange(5)] * rng.randrange(1, 6)}" for _ in range(rng.randrange(20, 120))]
        text = " ".join(words) + "." if good else " ".join(f"{w.upper()}!!! | $$" for w in words[: len(words) // 3 + 1])
        rows.append((i, text))
        labels.append((i, int(good if rng.random() > 0.02 else not good)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus(900)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    out = {r["doc_id"]: r for r in quality.score(docs, model).withColumn("held_out", quality.held_out()).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in out.items())
    held = [(out[i]["predicted"], y) for i, y in labels if out[i]["held_out"]]
    assert len(held) > 150 and np.mean([a == b for a, b in held]) > 0.94
    assert all(r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in out.values())


def test_held_out_labels_are_not_used(spark):
    rows, labels = corpus(300, 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in labels]
    one, two = (quality.train(docs, spark.createDataFrame(x, "doc_id long, quality int")) for x in (labels, turned))
    x = quality.features(pa.array([t for _, t in rows]))
    assert np.array_equal(one.score(x), two.score(x))


def test_scores_are_sums_of_lookups():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, len(quality.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # no single feature tells
    m = quality.fit(x, y)
    assert (1, 0) in m.pairs and np.mean((m.score(x) > 0.5) == y) > 0.9
    row = x[:1]
    z = m.intercept + sum(t[np.searchsorted(e, row[0, k], side="right")] for k, (e, t) in enumerate(zip(m.edges, m.tables, strict=True)))
    z += sum(t[np.searchsorted(m.coarse[a], row[0, a], side="right"), np.searchsorted(m.coarse[b], row[0, b], side="right")] for (a, b), t in zip(m.pairs, m.pair_tables, strict=True))
    assert np.isclose(m.score(row)[0], 1 / (1 + np.exp(-z)))


def test_edge_cases(spark):
    rows = [(1, None, "a"), (1, None, "a"), (2, "", "b"), (3, " \n", "c"), (None, "é" * 70_000, "d"), (4, "w " * 200_000, "e")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, score string")
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 0), (9, 0)], "doc_id int, quality int")
    out = quality.score(docs, quality.train(docs, labels))
    assert out.columns == ["doc_id", "text", "score", "predicted"]
    got = out.collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if not (r["text"] or "").strip()}) == 1
    empty = quality.train(docs.limit(0), labels.limit(0))
    assert {r["score"] for r in quality.score(docs, empty).collect()} == {0.5}
    assert quality.score(docs.limit(0), empty).count() == 0


def test_sample_is_bounded(spark):
    rows, labels = corpus(400, 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"), max_rows=150)
    right = [r["predicted"] == dict(labels)[r["doc_id"]] for r in quality.score(docs, model).collect()]
    assert np.mean(right) > 0.85
