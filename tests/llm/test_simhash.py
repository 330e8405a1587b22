import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from quarrystone.llm import simhash


def fingerprint(text):
    """By the definition, with one loop a bit."""
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    runs = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64(r.encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reached(rows, prints, most=4):
    """The smallest id that chains of all pairs reach."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(range(len(rows)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= most:
            root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return [least.get(find(i)) for i in range(len(rows))]


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["É", "Zug", "a", "naïve", "ß"]) + str(rng.randrange(2000))
    rows = []
    for _ in range(10):
        base = [word() for _ in range(rng.choice([3, 12, 80, 300]))]
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(rng.choice([" ", "\n\t", "\x0b"]).join(copy))
    rows += ["", None, " \n", "One", "one", "a b c", "A B C D", "x y z w v", "the same " * 50]
    rng.shuffle(rows)
    return [*((i + 10, t) for i, t in enumerate(rows)), (10, "ein Text zum zweiten Mal"), (None, "one"), (None, "only here without id")]


@pytest.mark.parametrize(("seed", "blocks", "tile"), [(1, None, 4096), (2, 8, 2), (3, 5, 3)])
def test_against_all_pairs(spark, seed, blocks, tile):
    rows = corpus(seed)
    prints = [fingerprint(t) for _, t in rows]
    docs = spark.createDataFrame([(a, b, i, i) for i, (a, b) in enumerate(rows)], "doc_id long, text string, fp int, key int")
    found = simhash.components(docs, tile=tile, blocks=blocks).select("doc_id", simhash.hex_of(), "component_id").collect()
    want = [(i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, reached(rows, prints), strict=True)]
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)


def test_long_texts_are_cut_without_loss(monkeypatch):
    rng = random.Random(7)
    text = " ".join(f"W{rng.randrange(50)}" * rng.randrange(1, 9) for _ in range(3000))
    want = fingerprint(text)
    for piece, part in ((1, 7), (100, 64), (10**6, 10**6)):
        monkeypatch.setattr(simhash, "PIECE", piece)
        monkeypatch.setattr(simhash, "SLICE", part)
        assert simhash.simhash(text) == want
    assert simhash.simhash("x" * 500) == fingerprint("x" * 500)


@pytest.mark.parametrize("blocks", [5, 6, 7, 8])
def test_every_close_pair_shares_a_key(blocks):
    rng = random.Random(blocks)
    keep = np.array(simhash.masks(blocks), np.int64).view(np.uint64)
    for bits in range(5):
        for _ in range(200):
            flips = sum(1 << b for b in rng.sample(range(64), bits))
            assert (keep & np.uint64(flips) == 0).any()


def test_blocks_follow_the_number_of_fingerprints():
    assert simhash.blocks_for(100) == 5
    assert [simhash.blocks_for(10**k) for k in range(3, 12)] == sorted(simhash.blocks_for(10**k) for k in range(3, 12))


def test_dense_groups_give_few_links(spark):
    """All fingerprints around one centre meet in many keys; what comes out connects them and is no list of all pairs."""
    rng = random.Random(1)
    some = sorted({sum(1 << b for b in rng.sample(range(63), rng.randrange(3))) for _ in range(1500)})
    prints = spark.createDataFrame([(x,) for x in some], "fp long")
    for tile in (4096, 100):
        links = simhash.links(prints, tile=tile).collect()
        assert len(links) < 8 * len(some)
        root = {x: x for x in some}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            root[find(a)] = find(b)
        assert len({find(x) for x in some}) == 1


def test_empty_table(spark):
    assert simhash.components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
