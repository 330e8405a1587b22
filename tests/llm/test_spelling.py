import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quarrystone.llm import spelling


def low(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def is_near(a, b):
    """One inserted, deleted or replaced code point, by trying all of them."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = low(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w] += 1
    words = {w: k for w, k in n.items() if k >= 5 and len(w) >= 6}
    near = {w: [x for x in words if x != w and is_near(w, x)] for w in words}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return sorted(out, key=repr)


def corpus(seed):
    """Words with variants of every kind, variants of variants, runs of one letter and ties."""
    rng = random.Random(seed)
    letters = "abcxyzàÿ×"
    stems = ["".join(rng.choice(letters) for _ in range(rng.randrange(6, 10))) for _ in range(25)] + ["aaaaaaaa", "abababab", "aaaaaabb"]
    bag = []
    for stem in stems:
        bag += [stem] * rng.choice([5, 30, 200])
        for _ in range(4):
            i, kind = rng.randrange(len(stem)), rng.randrange(3)
            other = stem[:i] + (rng.choice(letters) if kind else "") + stem[i + (kind < 2) :]
            bag += [other] * rng.choice([4, 5, 7, 40])
            bag += [other + rng.choice(letters)] * rng.choice([5, 6])
    bag += ["Élan" * 2, "MIXEDcase"] * 6 + ["zyxwvu" * 700, "zyxwvu" * 700 + "q"] * 5
    rng.shuffle(bag)
    texts = [rng.choice([" ", ", ", "1", "\n"]).join(bag[i : i + 40]) for i in range(0, len(bag), 40)]
    return [*enumerate(texts), (None, texts[0]), (3, texts[3]), (900, ""), (901, None), (902, "12 !")]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    rows = corpus(seed)
    want = brute(rows)
    docs = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "doc_id long, text string, n int, word string").repartition(5)
    found = sorted(map(tuple, spelling.variants(docs).collect()), key=repr)
    assert found == want
    assert sum(r[1] is not None for r in want) > 10 and any(r[2] != r[1] for r in want if r[1])


def test_some_runs_lose_a_code_point():
    assert any(w != "alphabet" for i in range(2000) for w, _ in spelling.occurrences(i, "Alphabet"))


def test_collisions_are_found_out_by_the_strings():
    """With keys of four bits nearly everything meets; comparing strings leaves each near pair once."""
    few = lambda words: (*spelling.deletion_keys(words)[:3], spelling.deletion_keys(words)[3] & np.uint64(15))
    rows = corpus(3)[:6]
    words = [w for w, *_ in brute(rows)]
    a = dict(zip(("rows", "pos", "first", "key"), few(words), strict=True))
    order = np.lexsort((a["pos"], a["key"]))
    x, y = spelling.met(a["key"][order], a["pos"][order], a["first"][order])
    seen = {(int(a["rows"][order][i]), int(a["rows"][order][j]), int(a["pos"][order][i]), int(a["pos"][order][j])) for i, j in zip(x, y, strict=True)}
    cut = lambda w, p: w if p < 0 else w[:p] + w[p + 1 :]
    true = [frozenset((words[i], words[j])) for i, j, p, q in seen if cut(words[i], p) == cut(words[j], q) and words[i] != words[j]]
    want = {frozenset((v, w)) for v in words for w in words if v < w and is_near(v, w)}
    assert len(true) == len(set(true)) and set(true) == want


def test_keys_are_those_of_the_strings():
    words = ["aabbcc", "abcdefg", "ÿ" * 6, "x" * 5000]
    rows, pos, first, key = spelling.deletion_keys(words)
    whole = {}
    for i, p, f, k in zip(rows, pos, first, key, strict=True):
        w = words[i]
        s = w if p < 0 else w[:p] + w[p + 1 :]
        assert whole.setdefault(s, k) == k
        assert f == (p < 1 or w[p] != w[p - 1])
    assert len(set(whole.values())) == len(whole)


def test_empty_table(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
