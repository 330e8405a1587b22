import functools
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrystone.llm import arrays, packed, pitmanyor, seating

def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 1


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 1


def tokens(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


def corpus(n=150, seed=1):
    """A first-order chain: the next word depends on the last."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        w, text = rng.randrange(40), []
        for _ in range(rng.randrange(1, 60)):
            text.append(f"W{w}" if rng.random() < 0.1 else f"w{w}")
            w = (w * 7 + rng.randrange(3)) % 40 if rng.random() < 0.9 else rng.randrange(400)
        rows.append((i, " ".join(text)))
    return [*rows, (n, None), (n + 1, ""), (n + 2, "unseen words ÄÖ")]


def scored(spark, rows):
    return {r["doc_id"]: r for r in pitmanyor.score(spark.createDataFrame(rows, "doc_id long, text string"), held_out()).collect()}


def test_counts_and_base_score(spark):
    rows = corpus()
    out = scored(spark, rows)
    c = Counter(t for i, text in rows if not held(i) for t in tokens(text))
    n, v = sum(c.values()), len(c)
    for i, text in rows:
        r, t = out[i], tokens(text)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), len(t), sum(x in c for x in t), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t), rel_tol=1e-9)
        assert math.isclose(r["perplexity"], 10 ** (-r["score"] / len(t)), rel_tol=1e-9)


def test_held_out_beats_the_base(spark):
    out = [r for r in scored(spark, corpus(400)).values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out) + 0.1 * sum(r["n_tokens"] for r in out)


def rising(base, step, n):
    return math.prod(base + step * i for i in range(n))


@functools.cache
def stirling(d, c, t):
    if c == t == 0:
        return 1.0
    if t < 1 or t > c:
        return 0.0
    return stirling(d, c - 1, t - 1) + (c - 1 - d * t) * stirling(d, c - 1, t)


def test_tables_of_one_restaurant_match_enumeration():
    count, base, d = np.array([40, 12, 5, 1]), np.array([0.4, 0.3, 0.2, 0.1]), 0.6
    exact, total = np.zeros(4), 0.0
    for t in itertools.product(*(range(1, c + 1) for c in count)):
        w = math.prod(stirling(d, int(c), k) * p**k for c, k, p in zip(count, t, base)) * rising(1, d, sum(t))
        exact, total = exact + w * np.array(t), total + w
    rng, rows = np.random.default_rng(1), 1500
    t, seen = np.ones((rows, 4), np.int64), np.zeros(4)
    for sweep in range(30):
        for i in range(4):
            t[:, i] = seating.draw(np.full(rows, count[i]), t.sum(axis=1) - t[:, i], d, 1.0, float(base[i]), rng)
        seen += t.mean(axis=0) * (sweep >= 10)
    assert np.allclose(seen / 20, exact / total, rtol=0.02)


@pytest.mark.parametrize("d", [0.1, 0.3, 0.6])
@pytest.mark.parametrize(("others", "base"), [(5000, 0.001), (20, 0.3), (5000, 0.05)])
def test_saddle_point_agrees_with_the_recursion(d, others, base):
    c = 500
    t = np.arange(1, c + 1)
    w = seating.log_stirling(d)[c, 1 : c + 1] + np.cumsum(np.log(1 + d * (others + t - 1))) + t * np.log(base)
    w = np.exp(w - w.max())
    exact = (w * t).sum() / w.sum()
    found = seating._draw_many(np.full(4000, float(c)), np.full(4000, others), d, 1.0, base, np.random.default_rng(3))
    assert abs(found.mean() - exact) < 0.03 * exact + 0.15


class Counted:
    """Random numbers, counted."""

    def __init__(self, seed):
        self.rng, self.n = np.random.default_rng(seed), 0

    def random(self, shape=None):
        out = self.rng.random(shape)
        self.n += np.size(out)
        return out


def test_a_dish_costs_one_random_number_and_no_more_weights_than_customers(monkeypatch):
    """Dishes used to be padded to 4, 8, 16, ... 512 tables, with a random number for each."""
    weighed = []
    monkeypatch.setattr(seating, "ENTRIES", 700)
    monkeypatch.setattr(seating, "_draw_some", lambda count, *r, f=seating._draw_some: (weighed.append(int(count.sum())), f(count, *r))[1])
    count = np.array([1, 2, 3, 5, 9, 17, 33, 65, 129, 512, 1, 2, 300])
    parent = seating.Parent(count % 7, np.minimum(count % 7, 3), 0.4, np.full(len(count), 0.2), np.full(len(count), 40.0))
    for up in (parent, 0.1):
        weighed.clear()
        rng = Counted(1)
        found = seating.draw(count, np.full(len(count), 10), 0.6, 1.0, up, rng)
        assert rng.n == (count > 1).sum() and sum(weighed) == count[count > 2].sum() and max(weighed) < 700 + 512
        assert (found >= 1).all() and (found <= count).all()


def test_draws_under_a_parent_match_their_weights():
    """Dishes of 2 to 40 customers side by side; the parent's cells lie before, at and beyond the end of the recursion. One parent can't have its tables."""
    d, d_up, theta, rows = 0.6, 0.4, 1.0, 4000
    kinds = [(2, 0, 1), (3, 4, 2), (4, 0, 9), (7, 0, 1), (12, 300, 20), (40, 480, 30), (5, 508, 30), (3, 2000, 40), (2, 511, 30), (40, 0, 1)]
    count, above, tables = (np.tile([k[i] for k in kinds], rows) for i in range(3))
    n = len(count)
    up = seating.Parent(above, tables, d_up, np.full(n, 0.7), np.full(n, 2500.0))
    found = seating.draw(count, np.full(n, 6), d, theta, up, np.random.default_rng(8)).reshape(rows, -1)
    s = seating.log_stirling(d_up)
    for i, (c, m, t) in enumerate(kinds):
        if t > m + c:
            assert (found[:, i] == 1).all()
            continue
        w = []
        for k in range(1, c + 1):
            own = math.log(stirling(d, c, k)) + sum(math.log(theta + d * (6 + j)) - math.log(2500 + j) for j in range(k))
            more = s[m + k, t] if m + c <= seating.EXACT else sum(math.log(m + j - d_up * min(t, m + j) + 0.7) for j in range(k))
            w.append(own + more)
        p = np.exp(np.array(w) - max(w))
        p /= p.sum()
        share = np.bincount(found[:, i], minlength=c + 1)[1:] / rows
        assert np.abs(share - p).max() < 0.035, (c, m, t)


def test_turns_hold_no_two_rows_of_a_restaurant_or_cell():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 50, 200), rng.integers(0, 60, 200)
    found = seating.turns(a, b, rng)
    assert sorted(np.concatenate(found).tolist()) == list(range(200))
    for x in found[:12]:
        assert len(set(a[x])) == len(set(b[x])) == len(x)


def test_three_levels_match_enumeration():
    """A block with two pairs of tokens under one token, and the root, against all seatings."""
    y, x1, x2, words = 5, 6, 7, [8, 9]
    cells = [(y, 8, x1, 3), (y, 8, x2, 2), (y, 9, x1, 1)]
    d, v = (0.5, 0.4, 0.3), 2
    at = lambda i: np.array([c[i] for c in cells], np.uint64)
    book = pitmanyor.Book(np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint64), 1)
    grams = pitmanyor.grams_of(at(0), at(1), at(2), at(3).astype(np.int64))

    exact, total = 0.0, 0.0
    for t81, t82, in itertools.product(range(1, 4), range(1, 3)):
        for above in range(1, t81 + t82 + 1):
            for root in range(1, above + 1):
                s = lambda k, c, t: stirling(d[k], c, t)
                w = s(2, 3, t81) * s(2, 2, t82) * rising(1, d[2], t81 + 1) * rising(1, d[2], t82)
                w *= s(1, t81 + t82, above) * rising(1, d[1], above + 1) / rising(1, 1, t81 + t82 + 1)
                w *= s(0, above, root) * rising(1, d[0], root + 1) / rising(1, 1, above + 1) / (v + 1) ** (root + 1)
                p = (above - d[0] * root + (1 + d[0] * (root + 1)) / (v + 1)) / (1 + above + 1)
                p = (t81 + t82 - d[1] * above + (1 + d[1] * (above + 1)) * p) / (1 + t81 + t82 + 1)
                p = (3 - d[2] * t81 + (1 + d[2] * (t81 + 1)) * p) / (1 + 4)
                exact, total = exact + w * p, total + w

    b = pitmanyor.Block({"grams": grams, "block": 0}, book)
    rng = np.random.default_rng(5)
    said = [{"block": 0, "part": p, "data": data} for p, data in b.messages(1, True)]
    shared, seen = None, []
    for sweep in range(700):
        rows = pitmanyor._answer(said, shared, (sweep,))
        sums = rows[-1]
        shared = pitmanyor.Shared(6, v, d, np.array([sums[4]]), np.array([sums[5]]))
        b.receive(1, [{"part": r[1], "data": r[2]} for r in rows if r[0] >= 0], shared)
        b.private[:] = False
        if sweep > 20:
            seen.append(b.predict()[0])
        b.plan(rng)
        b.sweep(rng)
        said = [{"block": 0, "part": p, "data": data} for p, data in b.messages(1, False)]
    assert words and abs(np.mean(seen) - exact / total) < 0.006


def plain_scores(rows, d, sweeps=12, samples=6):
    """Customer after customer leaves its table and sits down again, in restaurants of three levels."""
    rng = random.Random(9)
    grams = {i: [(t, (x, y)) for t, x, y in zip(toks, ["^", "^", *toks][1:], ["^", "^", *toks])] for i, text in rows for toks in [[str(x) for x in tokens(text)]]}
    train = [(t, c) for i, _ in rows if not held(i) for t, c in grams[i]]
    v = len({t for t, _ in train})
    seats = defaultdict(lambda: defaultdict(list))  # restaurant -> dish -> sizes of tables

    def chance(t, c):
        if c is None:
            return 1 / (v + 1)
        r = seats[c]
        n, tables = sum(map(sum, r.values())), sum(map(len, r.values()))
        return (sum(r[t]) - d[len(c)] * len(r[t]) + (1 + d[len(c)] * tables) * chance(t, c[:-1] if c else None)) / (1 + n)

    def sit(t, c):
        r, k = seats[c], len(c)
        new = (1 + d[k] * sum(map(len, r.values()))) * chance(t, c[:-1] if c else None)
        at = rng.random() * (sum(r[t]) - d[k] * len(r[t]) + new)
        for i, size in enumerate(r[t]):
            at -= size - d[k]
            if at < 0:
                r[t][i] += 1
                return
        r[t].append(1)
        if c:
            sit(t, c[:-1])

    def leave(t, c):
        r = seats[c][t]
        i = rng.choices(range(len(r)), r)[0]
        r[i] -= 1
        if not r[i]:
            del r[i]
            if c:
                leave(t, c[:-1])

    for t, c in train:
        sit(t, c)
    total = {i: [0.0] * len(g) for i, g in grams.items()}
    for s in range(sweeps):
        for t, c in train:
            leave(t, c)
            sit(t, c)
        if s >= sweeps - samples:
            for i, g in grams.items():
                total[i] = [a + chance(t, c) / samples for a, (t, c) in zip(total[i], g)]
    return {i: sum(map(math.log10, p)) for i, p in total.items()}


def test_scores_are_those_of_seating_customer_after_customer(spark, monkeypatch):
    found = []
    real = pitmanyor._next_words
    monkeypatch.setattr(pitmanyor, "_next_words", lambda s, p, now, *r: (found.append(now.discounts), real(s, p, now, *r))[1])
    rows = corpus(60)
    out = scored(spark, rows)
    plain = plain_scores(rows, found[0])
    kept = [i for i, _ in rows if held(i)]
    assert math.isclose(sum(out[i]["score"] for i in kept), sum(plain[i] for i in kept), rel_tol=0.02)
    for i, text in rows:
        assert abs(out[i]["score"] - plain[i]) < 0.06 * len(tokens(text)) + 0.3


def test_shared_restaurants_of_frequent_tokens_and_many_blocks(spark, monkeypatch):
    rows = corpus(300)
    one = scored(spark, rows)
    monkeypatch.setattr(pitmanyor, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(pitmanyor, "CHUNK_BYTES", 3000)
    many = scored(spark, rows)
    assert len(many) == len(rows)
    for i, _ in rows:
        assert (one[i]["n_known"], one[i]["base_score"]) == (many[i]["n_known"], pytest.approx(many[i]["base_score"], abs=1e-6))
    a, b = (sum(r["score"] for i, r in x.items() if held(i)) for x in (one, many))
    assert math.isclose(a, b, rel_tol=0.02)


def test_blocks_share_buckets_and_parts_above_their_bound(spark, monkeypatch):
    """More blocks than buckets: same counts and base scores, close scores, and messages of an exchange in blocks times buckets at most."""
    rows = corpus(300)
    one = scored(spark, rows)
    monkeypatch.setattr(pitmanyor, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(pitmanyor, "BUCKETS", 3)
    sent, real = [], pitmanyor.exchange
    monkeypatch.setattr(pitmanyor, "exchange", lambda said, parts, *r: (sent.append((parts, said.where("part >= 0").agg(F.max("part"), F.count("*"), F.count_distinct("block")).first())), real(said, parts, *r))[1])
    many = scored(spark, rows)
    for parts, (last, n, blocks) in sent:
        assert parts == 3 and last < 3 and blocks > 6 and n <= 3 * blocks
    assert len(many) == len(rows)
    for i, _ in rows:
        assert (one[i]["n_known"], one[i]["base_score"]) == (many[i]["n_known"], pytest.approx(many[i]["base_score"], abs=1e-6))
    a, b = (sum(r["score"] for i, r in x.items() if held(i)) for x in (one, many))
    assert math.isclose(a, b, rel_tol=0.02)


def test_long_text_and_clashing_columns(spark):
    long = " ".join(f"w{i % 5000}" for i in range(60_000))
    rows = [(1, long, 0.5, 7), (2, "w1 w2 w3", 0.5, 7), (3, None, None, None)]
    out = pitmanyor.score(spark.createDataFrame(rows, "doc_id long, text string, score double, held int"), held_out()).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in out} == {1: 60_001, 2: 4, 3: 1}
    assert all(r["score"] < 0 for r in out)


def test_packed_arrays_come_back():
    rng = np.random.default_rng(6)
    for x in (np.zeros(0, np.int64), np.array([0]), rng.integers(0, 1 << 40, 1000)):
        assert (packed.unpack(packed.pack(x)) == x).all()
    keys = np.concatenate((np.arange(1, 50, dtype=np.uint64), rng.integers(0, 1 << 62, 50).astype(np.uint64) | packed.RARE))
    assert (packed.unpack_keys(packed.pack_keys(keys)) == keys).all()


def test_repeats_nulls_and_empty(spark):
    rows = [(1, "a b"), (1, "a b"), (None, "a b"), (2, "a c")]
    out = pitmanyor.score(spark.createDataFrame(rows, "doc_id int, text string"), held_out()).collect()
    assert len(out) == 4 and len({r["score"] for r in out if r["doc_id"] != 2}) == 1
    assert pitmanyor.score(spark.createDataFrame([], "doc_id long, text string"), held_out()).count() == 0
    assert pitmanyor.score(spark.createDataFrame([(None, "x y")], "doc_id long, text string"), held_out()).first()["train_tokens"] == 0


def test_distinct_rows_and_values_are_those_of_numpy():
    rng = np.random.default_rng(7)
    for x in (np.zeros(0, np.uint64), rng.integers(0, 50, 1000).astype(np.uint64) << np.uint64(57), rng.integers(-9, 9, 100)):
        for a, b in zip(arrays.distinct(x), np.unique(x, return_inverse=True), strict=True):
            assert (a == b).all()
    columns = tuple(rng.integers(0, n, 3000) for n in (30, 20, 9))
    for sizes in ((30, 20, 9), (1 << 30, 1 << 30, 9)):  # together below and above 63 bits
        found, start = pitmanyor._sorted(columns, sizes)
        rows, counts = np.unique(np.stack(columns, axis=1), axis=0, return_counts=True)
        assert (np.stack(found, axis=1) == rows).all() and (np.diff(start, append=3000) == counts).all()


def test_a_block_writes_each_word_once():
    one, word, two = np.array([3, 3, 3, 4, 4], np.uint64), np.array([5, 5, 6, 5, 6], np.uint64) | packed.RARE, np.array([7, 8, 7, 7, 8], np.uint64) | packed.RARE
    g = pitmanyor.Grams.read(pitmanyor.grams_of(one, word, two, np.ones(5, np.int64)))
    assert g.words.tolist() == sorted(set(word.tolist())) and g.twos.tolist() == sorted(set(two.tolist()))
    assert (g.words[np.repeat(g.word, g.cells)] == word).all() and (g.twos[g.two] == two).all()


def test_hashes_do_not_depend_on_how_many_bytes_are_summed_at_once(monkeypatch):
    rng = random.Random(3)
    texts = pa.array([" ".join("".join(rng.choices("abcÄ€", k=rng.choice([1, 3, 9, 40]))) for _ in range(200)) for _ in range(5)] + ["x" * 200_000 + " y", "", None])
    h = arrays.words_of(texts).h
    for size in (16, 1000):
        monkeypatch.setattr(arrays, "SLICE", size)
        assert (arrays.words_of(texts).h == h).all()
