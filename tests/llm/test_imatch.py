import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from quarrystone.llm import imatch


def corpus(n=80, seed=1):
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 900}"
    rows = [(3 * i, " ".join(word() for _ in range(rng.randrange(1, 80)))) for i in range(n)]
    return [*rows, (1, None), (2, ""), (4, "naïve Ünïcode 漢字 " * 20), (5, rows[7][1]), (7, rows[7][1])]


def edited(rows):
    rows = sorted((i, t or "") for i, t in rows)
    out = {}
    for k, (i, a) in enumerate(rows):
        b = rows[(k + 1) % len(rows)][1]
        m = len(a) // 2
        out[i] = (a, a[: len(a) - m] + b[:m], b)
    return out


@pytest.mark.parametrize("parts", ["1", "4"])
def test_edits_and_likeness(spark, parts):
    rows = corpus()
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        found = {r["doc_id"]: r for r in imatch.edited_fingerprints(docs).collect()}
        terms = imatch.lexicon(docs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = edited(rows)
    assert found.keys() == want.keys()
    prints = lambda texts: imatch.fingerprints(pa.array(texts), terms)
    for i, (a, e, b) in want.items():
        r = found[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(a), hashlib.sha256(e.encode()).hexdigest())
        x, y, z = prints([a]), prints([e]), prints([b])
        assert (r["fingerprint"], r["edited_fingerprint"]) == (imatch._hex(x[0])[0], imatch._hex(y[0])[0])
        assert r["near_edited"] == imatch.likeness(x, y)[0] and r["near_next"] == imatch.likeness(x, z)[0]
    assert found[5]["fingerprint"] == found[7]["fingerprint"] == found[21]["fingerprint"]
    assert found[5]["near_next"] < found[5]["near_edited"] <= 1


def test_lexicon_is_the_band(spark):
    rows = corpus(200)
    df = {}
    for _, t in rows:
        for w in {x.lower() for x in (t or "").split(" ") if x}:
            df[w] = df.get(w, 0) + 1
    n = len(rows)
    assert len(imatch.lexicon(spark.createDataFrame(rows, "doc_id long, text string"), 0.01, 0.1)) == sum(max(2, 0.01 * n) <= k <= 0.1 * n for k in df.values())


def test_terms_outside_the_band_and_their_order_do_not_matter():
    terms = np.sort(imatch.words_of(pa.array(["a b c d e"])).h)
    one, two = (imatch.fingerprints(pa.array([t]), terms) for t in ("a b c d zz", "d C b b yy A"))
    assert (one[0] == two[0]).all() and imatch.likeness(one, two)[0] == 1


def test_fingerprint_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 7), (2, None, 8), (2, None, 8)], "doc_id int, text string, fingerprint int")
    out = imatch.fingerprint(docs, np.zeros(0, np.uint64))
    assert out.columns == ["doc_id", "text", "fingerprint"] and out.count() == 3


def test_single_repeated_null_and_empty(spark):
    one = imatch.edited_fingerprints(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()
    rows = [(1, "x y"), (1, "x y"), (None, "z"), (2, None)]
    assert imatch.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).count() == 4
    assert imatch.edited_fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rows_without_an_id_follow_by_a_hash_over_many_ranges(spark):
    docs = spark.createDataFrame([(i if i < 20 else None, f"text {i} and {i * 7}") for i in range(120)], "doc_id long, text string")
    dealt = imatch.with_successors(docs)
    assert dealt.where("doc_id is null and ghost = 0").select("bucket").distinct().count() > 1
    out = imatch.edited_fingerprints(docs).collect()
    assert len(out) == 120 and sum(r["doc_id"] is None for r in out) == 100
