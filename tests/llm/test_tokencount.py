import random

import pytest

from quarrystone.llm import tokencount


def whole_text(counter, text):
    return len(counter.encoding.encode_ordinary(text))


def edited(text, edits):
    """Edits are in places of the text as it is when they are applied, one after another."""
    for start, end, new in edits:
        text = text[:start] + new + text[end:]
    return text


@pytest.fixture(scope="module")
def counter():
    return tokencount.Counter()


@pytest.mark.parametrize("seed", range(6))
def test_counts_after_edits_are_those_of_the_whole_text(counter, seed):
    rng = random.Random(seed)
    piece = lambda: rng.choice([" the", "  ", "\n\n", "don't", "été", "漢字", "123456", "!!", " ", "\t", "aB", "😀", "'s", "x" * 80])
    text = "".join(piece() for _ in range(rng.choice([0, 3, 400])))
    tree = tokencount.TokenTree(text, counter)
    assert tree.total == whole_text(counter, text)
    for _ in range(60):
        a = rng.randrange(len(text) + 1)
        b = min(len(text), a + rng.choice([0, 0, 1, 5, 60]))
        new = "".join(piece() for _ in range(rng.choice([0, 1, 1, 9])))
        tree.edit(a, b, new)
        text = edited(text, [(a, b, new)])
        assert tree.total == whole_text(counter, text)


def test_spaces_at_block_borders(counter):
    """A run of spaces ends one before a word, so an edit reaches back by a pre-token."""
    text = "a   b 'l" * 150
    for at in range(300, 420):
        tree = tokencount.TokenTree(text, counter)
        tree.edit(at, at, " l")
        assert tree.total == whole_text(counter, edited(text, [(at, at, " l")]))


def test_columns_nulls_and_repeats(spark, counter):
    rows = [
        (1, "Hello there, world", [(0, 5, "Goodbye")], 5), (1, "Hello there, world", [(0, 5, "Goodbye")], 5), (2, None, [(0, 0, "new text")], 5), (3, "", None, 5), (None, "a b", [], 5),
        (4, "some words " * 20000, [(7, 9, "é"), (100, 100, "  zz")], 5),
    ]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, edits {tokencount.EDIT_TYPE}, n_tokens int")
    out = tokencount.count_tokens(docs)
    got = out.collect()
    assert len(got) == 6
    for r in got:
        want = next(x for x in rows if x[0] == r["doc_id"])
        assert r["n_tokens"] == whole_text(counter, want[1] or "")
        assert r["edited_tokens"] == whole_text(counter, edited(want[1] or "", want[2] or []))
    assert tokencount.count_tokens(docs.limit(0)).count() == 0


def test_kept_trees_are_edited_without_encoding_the_text_again(spark, counter):
    text = "the quick brown fox jumps over it. " * 600
    docs = spark.createDataFrame([(1, text, [(100, 104, "slow"), (9000, 9000, " a b c" * 900)]), (2, None, None)], f"doc_id long, text string, edits {tokencount.EDIT_TYPE}")
    first = {r["doc_id"]: r for r in tokencount.count_tokens(docs, keep_tree=True).collect()}
    assert first[1]["edited_tokens"] == whole_text(counter, first[1]["edited_text"])
    again = [(i, r["edited_text"], [(50, 60, "X")], r["tree"]) for i, r in first.items()]
    later = spark.createDataFrame(again, f"doc_id long, text string, edits {tokencount.EDIT_TYPE}, tree {tokencount.TREE_TYPE}")
    out = {r["doc_id"]: r for r in tokencount.count_tokens(later, keep_tree=True).collect()}
    assert out[1]["n_tokens"] == first[1]["edited_tokens"] and out[1]["reencoded_chars"] < 2000
    assert all(r["edited_tokens"] == whole_text(counter, r["edited_text"]) for r in out.values())


def test_leaves_split_where_much_is_put_in(counter):
    tree = tokencount.TokenTree(" word" * 3000, counter)
    tree.encoded = 0
    tree.edit(7000, 7000, " more and more" * 2000)
    assert tree.total == whole_text(counter, tree.text) and tree.encoded < len(" more and more" * 2000) + 2000
