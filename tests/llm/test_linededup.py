import random

from quarrystone.llm import linededup


def brute(rows):
    """Kept text and number of removed lines, by the definition, over (doc_id, text) with distinct ids."""
    seen, gone = set(), {i: set() for i, _ in rows}
    for i, text in sorted(rows):
        lines = [(k, line.strip(" \t\r")) for k, line in enumerate((text or "").split("\n")) if line.strip(" \t\r")]
        for j in range(len(lines) - 2):
            window = tuple(x for _, x in lines[j : j + 3])
            if window in seen:
                gone[i].update(k for k, _ in lines[j : j + 3])
            seen.add(window)
    return {i: (None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]), len(gone[i])) for i, t in rows}


def test_against_the_definition(spark):
    rng = random.Random(3)
    passages = [[f"line {rng.randrange(40)}" for _ in range(rng.randrange(3, 8))] for _ in range(6)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randrange(1, 5)):
            lines += rng.choice([rng.choice(passages), [f"own {i} {rng.random()}"], ["", "  "], ["same"] * rng.randrange(1, 9)])
        rows.append((i, "\n".join(rng.choice([" ", ""]) + x + rng.choice(["\r", ""]) for x in lines)))
    rows += [(100, None), (101, ""), (102, "a\nb"), (103, "\n\n")]
    out = linededup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: (r["text"], r["n_removed"]) for r in out.collect()} == brute(rows)


def test_first_occurrence_stays_and_overlaps_merge(spark):
    rows = [(2, "a\nb\nc\nd\ne"), (1, "a\nb\nc\nd"), (3, "x\na\nb\nc\nd\ny")]
    out = {r["doc_id"]: r["text"] for r in linededup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: "a\nb\nc\nd", 2: "e", 3: "x\ny"}


def test_repeated_rows_clashing_columns_and_empty(spark):
    docs = spark.createDataFrame([(1, "p\nq\nr", 5), (1, "p\nq\nr", 5), (None, "p\nq\nr", 6)], "doc_id long, text string, n_removed int")
    out = linededup.drop_repeated_lines(docs)
    assert out.columns == ["doc_id", "text", "n_removed"]
    assert out.count() == 3
    assert linededup.drop_repeated_lines(docs.limit(0)).count() == 0
