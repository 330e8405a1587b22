import random
import re

from pyspark.sql import functions as F

from quarrystone.llm import substring


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(rows):
    least = {}
    for i, text in rows:
        w = words(text)
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            least[key] = min(least.get(key, i), i)
    out = {}
    for i, text in rows:
        w = words(text)
        gone = set()
        for k in range(len(w) - 49):
            if least[tuple(w[k : k + 50])] < i:
                gone.update(range(k, k + 50))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def found(spark, rows):
    out = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in out.collect()}


def corpus(seed, n=50):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "été", f"w{rng.randrange(500)}"])
    passages = [[word() for _ in range(k)] for k in (49, 50, 51, 80, 200, 400)]
    rows = []
    for i in range(n):
        text = []
        for _ in range(rng.randrange(1, 4)):
            text += [word() for _ in range(rng.randrange(30))]
            p = rng.choice(passages)
            a = rng.randrange(max(1, len(p) - 60))
            text += p[a : a + rng.randrange(40, 300)]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(text)))
    return rows


def test_against_all_windows(spark):
    rows = [*corpus(1), (200, None), (201, ""), (202, "a b"), (203, " ".join(["ha"] * 300)), (204, " ".join(["ha"] * 120))]
    assert found(spark, rows) == brute(rows)


def test_hot_passage_and_exact_copies(spark):
    p = " ".join(f"p{i}" for i in range(70))
    rows = [(i, f"a{i} {p} b{i}") for i in range(80)] + [(i, p) for i in range(100, 140)]
    assert found(spark, rows) == brute(rows)


def test_non_breaking_space_is_no_separator(spark):
    rows = [(1, " ".join(f"p {i}" for i in range(50))), (2, "x " + " ".join(f"p {i}" for i in range(50)))]
    assert found(spark, rows)[2] == (51, 50, "x")


def test_columns_and_null_ids(spark):
    p = " ".join(f"p{i}" for i in range(60))
    docs = spark.createDataFrame([(1, p, 4), (None, p, 5), (1, p, 4), (2, p, 6)], "doc_id int, text string, n_words int")
    out = substring.remove_repeats(docs)
    assert out.columns == ["doc_id", "text", "kept_text", "n_words", "n_removed"]
    assert {(r["doc_id"], r["n_removed"]) for r in out.collect()} == {(1, 0), (None, 0), (2, 60)}
    assert substring.remove_repeats(docs.limit(0)).count() == 0


def test_a_full_sketch_only_lets_more_through(spark, monkeypatch):
    """With few cells everything seems repeated, and the exact pass still gives the same rows."""
    rows = corpus(7, 20)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tag", F.xxhash64("text"))
    full = [substring.np.full(1 << (substring.CELL_BITS - 3), 255, substring.np.uint8)] * substring.SKETCH_ROWS
    monkeypatch.setattr(substring, "sketch", lambda _: full)
    assert found(spark, [(r["doc_id"], r["text"]) for r in docs.collect()]) == brute(rows)
