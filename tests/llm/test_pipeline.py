import functools
import random

import pytest

import __spark_entry__
import corpus_pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(4000)}"
    docs, labels = [], []
    passage = "\n".join(" ".join(word() for _ in range(8)) for _ in range(4))
    for i in range(160):
        good = i % 4 != 3
        text = "\n".join(" ".join(word() for _ in range(9)) + "." for _ in range(rng.randrange(5, 12)))
        if i % 10 == 0:
            text += "\n" + passage
        docs.append((i, text if good else "BUY!!! $$ NOW " * 30, "en", f"s{i % 3}", 0))
        labels.append((i, int(good), 0))
    docs += [(1000 + i, docs[i][1].replace("\n", " ") + " q1", "en", "s0", 0) for i in (1, 2, 6, 8, 13, 17)]  # one line: line dedup leaves them alone
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages_each_work_on_what_was_kept(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        kept.append(out.toPandas())
        if k < 4:
            assert out.columns == columns
        docs = spark.createDataFrame(kept[-1]) if k < 4 else docs
    good, lined, single, mixed, packed = kept
    assert len(good) > 100 and not good["text"].str.contains("BUY").any()
    assert sorted(good["doc_id"]) == sorted(lined["doc_id"]) and (lined["n_chars"] == lined["text"].str.len()).all()
    assert len(single) < len(lined) and set(range(0, 160, 4)) <= set(single["doc_id"])
    assert sorted(single["doc_id"]) == sorted(mixed["doc_id"]) and set(packed["doc_id"]) == set(mixed["doc_id"])
    assert packed.groupby("doc_id")["n_words"].sum().to_dict() == {i: len(t.split()) for i, t in zip(mixed["doc_id"], mixed["text"], strict=True)}


def test_run_gives_the_last_stage(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["bin", "doc_id", "source", "piece", "first_word", "n_words", "cluster"] and out.count() > 90


def test_another_mixture_changes_the_bins(spark, folder, monkeypatch, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    real, bins = corpus_pipeline.mixing.mix_sources, []
    monkeypatch.setattr(corpus_pipeline.packing, "GROUP", 20)
    monkeypatch.setattr(corpus_pipeline.packing, "pack", functools.partial(corpus_pipeline.packing.pack, group=20))
    for k, weights in enumerate(({"s0": 8.0, "s1": 1.0, "s2": 1.0}, {"s0": 1.0, "s1": 1.0, "s2": 8.0})):
        monkeypatch.setattr(corpus_pipeline.mixing, "mix_sources", lambda d, w=weights: real(d, w, block=2))
        corpus_pipeline.mix(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        out = corpus_pipeline.fill(spark, spark.read.parquet(f"{tmp_path}/{k}"), folder).collect()
        first = min(r["bin"].split(":")[0] for r in out if not r["bin"].startswith("full"))
        bins.append({r["doc_id"]: r["source"] for r in out if r["bin"].startswith(f"{first}:")})
    assert sum(s == "s0" for s in bins[0].values()) > len(bins[0]) / 2 and sum(s == "s2" for s in bins[1].values()) > len(bins[1]) / 2


def test_columns_with_operators_names_stay(spark, folder):
    own = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "doc_id * 2 as score", "'x' as predicted", "7 as n_removed", "'y' as mix_block", "cast(null as string) as tag")
    docs = own
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, folder)
        assert out.columns == own.columns
        docs = spark.createDataFrame(out.toPandas(), own.schema)
    assert docs.count() and docs.where("score <> doc_id * 2 or predicted <> 'x' or n_removed <> 7 or mix_block <> 'y' or tag is not null").count() == 0


def test_nulls_and_empty_tables(spark, folder):
    schema = spark.read.parquet(f"{folder}/documents.parquet").schema
    odd = spark.createDataFrame([(None, None, None, None, None), (5, "", "en", None, 0), (5, "", "en", None, 0), (None, "one two", None, "s1", None)], schema)
    for docs in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, folder).collect()


def test_registered():
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n[2].isdigit()) == list(range(1, 14)) and "pipeline" in __spark_entry__.queries()
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
