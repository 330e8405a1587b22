import hashlib
import json
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrystone.functions import clean
from quarrystone.operators import bitmaps, identity, metrics, quality_rules, retrieval, segments, serving, textindex, vectorindex
from quarrystone.plans import scan
from quarrystone.sources import contracts, readers, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_phone_and_email_forms(spark):
    forms = {"98765 43210": "+919876543210", "09876543210": "+919876543210", "+91-9876543210": "+919876543210", "0919876543210": "+919876543210", "12345": None}
    for raw, want in forms.items():
        assert one(spark, clean.phone(F.lit(raw))) == want
    assert one(spark, clean.email(F.lit("  A@B.Com. "))) == "a@b.com" and one(spark, clean.email(F.lit("  "))) is None
    assert one(spark, clean.without_sentinel(F.lit(" N/A "))) is None


def test_csv_is_read_as_strings_with_lineage(spark, tmp_path):
    names = [f.name for f in contracts.PRODUCTS.fields]
    sep = contracts.PRODUCTS.options.get("sep", contracts.PRODUCTS.options.get("delimiter", ","))
    (tmp_path / "p.csv").write_text("\n".join([sep.join(names), sep.join(["1"] * len(names)), sep.join(["x"] * len(names))]))
    raw = readers.read_raw(spark, str(tmp_path / "p.csv"), contracts.PRODUCTS, run_id=4)
    rows = raw.collect()
    assert [r["_source_row_num"] for r in rows] == [1, 2] and {r["_run_id"] for r in rows} == {4}
    assert all(t == "string" for n, t in raw.dtypes if n in names)
    typed = contracts.typed(raw, contracts.PRODUCTS)
    assert {f"{n}_typed" for n in names} <= set(typed.columns) and typed.count() == 2


def test_rows_are_numbered_over_the_blocks_of_each_file(spark, tmp_path):
    key = contracts.ORDERS.key[0]
    for name, n in (("a", 400), ("b", 3), ("c", 250)):
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps({key: i}) + "\n" for i in range(1, n + 1)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        raw = readers.read_raw(spark, str(tmp_path), contracts.ORDERS)
        assert spark.read.text(str(tmp_path)).select("_metadata.file_path", "_metadata.file_block_start").distinct().count() > 3
        rows = raw.select(key, "_source_row_num", "_source_file").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 653 and all(int(r[key]) == r["_source_row_num"] for r in rows)


def test_broken_json_lines_survive(spark, tmp_path):
    key = contracts.ORDERS.key[0]
    (tmp_path / "o.jsonl").write_text(json.dumps({key: 7}) + "\n{broken\n")
    rows = readers.read_raw(spark, str(tmp_path / "o.jsonl"), contracts.ORDERS).orderBy("_source_row_num").collect()
    assert [r[key] for r in rows] == ["7", None] and rows[1][readers.CORRUPT] == "{broken"


def test_bad_values_become_null_in_typing(spark):
    f = contracts.Field("x", "decimal")
    assert float(one(spark, contracts.typed_column(f, F.lit("₹ 1,234.50")))) == 1234.5
    assert one(spark, contracts.typed_column(f, F.lit("abc"))) is None
    assert one(spark, contracts.typed_column(contracts.Field("x", "boolean"), F.lit("YES"))) is True
    assert one(spark, contracts.typed_column(contracts.Field("x", "integer"), F.lit("unknown"))) is None


def test_upserts_match_null_keys(spark):
    old = spark.createDataFrame([(1, "a"), (None, "n"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([("B", 2), ("N", None), ("C", 3)], "v string, k int")
    assert {tuple(r) for r in sinks.upserted(old, new, ["k"]).collect()} == {(1, "a"), (2, "B"), (None, "N"), (3, "C")}
    assert {tuple(r) for r in sinks.upserted(old, new, ["k"], update=False).collect()} == {(1, "a"), (2, "b"), (None, "n"), (3, "C")}


def test_stage_log_records_failures(spark, tmp_path):
    with sinks.Stage(spark, str(tmp_path), 1, "good") as s:
        s.rows = 3
    with pytest.raises(KeyError), sinks.Stage(spark, str(tmp_path), 1, "bad", 1):
        raise KeyError("why")
    log = {r["stage"]: r for r in spark.read.parquet(f"{tmp_path}/stage_runs").collect()}
    assert (log["good"]["status"], log["good"]["rows"], log["bad"]["status"]) == ("succeeded", 3, "failed") and "why" in log["bad"]["error"]


def test_partition_overwrite_leaves_others(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.overwrite_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "v int, p string"), path, ["p"])
    sinks.overwrite_partitions(spark.createDataFrame([(9, "b")], "v int, p string"), path, ["p"])
    assert {(r["v"], r["p"]) for r in spark.read.parquet(path).collect()} == {(1, "a"), (9, "b")}


def test_rules_are_checked_and_nulls_follow_the_setting(spark):
    leaf = {"op": ">=", "field": "total_spend", "value": {"param": "p"}}
    for bad in ({"op": ">", "field": "password", "value": 1}, {"op": "IN", "field": "total_spend", "value": [1]}, leaf, {"op": "AND", "children": []}):
        with pytest.raises(segments.RuleError):
            segments.compile_rule(bad, {})
    base = spark.createDataFrame([("a", 10.0), ("b", 1.0), ("c", None)], "canonical_customer_id string, total_spend double")
    pick = lambda handling, rule=leaf: {r[0] for r in base.where(segments.compile_rule(rule, {"p": 5}, handling)).select("canonical_customer_id").collect()}
    assert pick("exclude") == {"a"} and pick("include") == {"a", "c"} and pick("exclude", {"op": "NOT", "child": leaf}) == {"b"}


def test_oversized_clusters_lose_their_weakest_edges(spark):
    edges = spark.createDataFrame(
        [("r:1", "r:2", "R-01", 0.99), ("r:2", "r:3", "R-02", 0.95), ("r:3", "r:4", "R-02", 0.9), ("r:8", "r:9", "R-03", 0.8)],
        "record_a string, record_b string, rule_id string, confidence double",
    )
    records = spark.createDataFrame([(f"r:{i}",) for i in (1, 2, 3, 4, 7, 8, 9)], "source_record_key string")
    found = identity.clusters(records, edges)
    after, review = identity.guard(found, edges, identity.Settings(max_cluster_size=3))
    groups = {}
    for r in after.collect():
        groups.setdefault(r["cluster_key"], set()).add(r["source_record_key"])
    assert sorted(map(sorted, groups.values())) == [["r:1", "r:2", "r:3"], ["r:4"], ["r:7"], ["r:8"], ["r:9"]]
    assert {r["reason"] for r in review.collect()} == {"cluster_too_large", "attribute_conflict"}


def cut_down(edges, limit):
    """Edges that stay, cluster by cluster: by falling confidence and then by the larger record, step by step while all parts fit."""
    def parts(some):
        root = {}

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for a, b, *_ in some:
            root[find(a)] = find(b)
        return {x: find(x) for x in list(root)}

    kept, whole = [], parts(edges)
    for cluster in set(whole.values()):
        own = [e for e in edges if whole[e[0]] == cluster]
        steps = sorted({(-e[3], max(e[:2])) for e in own})
        fits = [s for s in steps if max([0, *(list(p.values()).count(v) for p in [parts([e for e in own if (-e[3], max(e[:2])) <= s])] for v in set(p.values()))]) <= limit]
        kept += [e for e in own if fits and (-e[3], max(e[:2])) <= fits[-1]]
    return {frozenset(x for x, v in p.items() if v == r) for p in [parts(kept)] for r in set(p.values())}


def test_oversized_clusters_are_cut_as_step_by_step(spark, limit=5):
    rng = random.Random(limit)
    pairs = [(f"r:{i:02}", f"r:{j:02}", "R-02", rng.choice([0.95, 0.9, 0.8])) for i in range(12) for j in range(i + 1, 12) if (i + j) % 4]
    pairs += [(f"s:{i}", f"s:{i + 1}", "R-02", 0.9) for i in range(8)] + [("t:0", f"t:{i}", "R-02", 0.9) for i in range(1, 40)]
    pairs += [(min(a, b), max(a, b), "R-01", c) for a, b, c in ((f"u:{rng.randrange(30)}", f"u:{rng.randrange(30)}", rng.choice([1.0, 0.8])) for _ in range(45)) if a != b]
    pairs = list({p[:2]: p for p in pairs}.values())
    edges = spark.createDataFrame(pairs, "record_a string, record_b string, rule_id string, confidence double")
    found = identity.clusters(edges.selectExpr("explode(array(record_a, record_b)) as source_record_key"), edges)
    after, review = identity.guard(found, edges, identity.Settings(max_cluster_size=limit))
    groups = {}
    for r in after.collect():
        groups.setdefault(r["cluster_key"], set()).add(r["source_record_key"])
    assert all(k == min(g) for k, g in groups.items())
    assert {frozenset(g) for g in groups.values() if len(g) > 1} == cut_down(pairs, limit)
    assert {r["reason"] for r in review.collect()} == {"cluster_too_large"}
    assert identity.review_members(found, review).count() == found.join(review, found["cluster_key"] == review["candidate_cluster_key"]).count()


def test_the_guard_does_not_see_how_frequent_values_are_joined(spark):
    """A value of so many records is joined by all pairs, or of one more by stars: the same clusters after the guard."""
    ids = [("a", f"{i:03}", "email", "one@x") for i in range(40)] + [("a", f"{i:03}", "phone", "+1") for i in range(20, 60)] + [("a", f"{i:03}", "phone", "+2") for i in (3, 70, 71)]
    attrs = spark.createDataFrame([("a", f"{i:03}", f"n{i % 3}", f"f{i % 2}", f"n{i % 3} f{i % 2}") for i in range(72)], "source_system string, source_record_id string, first_name_norm string, last_name_norm string, full_name_norm string")
    rows = spark.createDataFrame(ids, "source_system string, source_record_id string, identity_namespace string, identity_value_norm string")
    screened = identity.durable(identity.screen(rows, None))
    after = []
    for most in (40, 39):
        edges = identity.durable(identity.match(screened, attrs, most=most))
        found = identity.durable(identity.clusters(identity.record_keys(rows), edges))
        after.append(sorted(identity.guard(found, edges, identity.Settings(max_cluster_size=25))[0].collect()))
    assert after[0] == after[1] and max(Counter(k for _, k in after[0]).values()) == 25


def test_unknown_rule_types_are_refused(spark):
    with pytest.raises(ValueError):
        quality_rules.classify(spark.range(1), [quality_rules.Rule("X", "", "validity", "no_such_type")]).collect()


def test_markdown_is_cut_by_headings_and_length(spark):
    text = "intro\n\n## One\nfirst\n### Two\n" + "\n\n".join("p" * 40 for _ in range(5))
    found = lambda t, n=900: [tuple(r) for r in retrieval.chunks(spark.createDataFrame([(1, t)], "doc_id int, text string"), longest=n).orderBy("chunk_no").select("section", "content").collect()]
    out = found(text, 100)
    assert out[0] == ("Introduction", "intro") and out[1] == ("One", "first")
    assert [s for s, _ in out[2:]] == [f"Two (part {i})" for i in (1, 2, 3)] and all(len(c) <= 100 for _, c in out)
    assert found("") == [] and found(None) == [] and found(" \n\n") == []
    assert found("## A\r\nx\n#### no\n##none\n##  B \n" + "y" * 950 + "\n\n\n\n\nz") == [("A", "x\n#### no\n##none"), ("B (part 1)", "y" * 950), ("B (part 2)", "z")]


def test_sessions_split_at_gaps_and_ties(spark):
    rows = [(1, "u", "d", "view", "2024-01-01 00:00:00"), (2, "u", "d", "view", "2024-01-01 00:30:00"), (3, "u", "d", "purchase", "2024-01-01 01:00:01"), (4, "u", "d", "view", "2024-01-01 01:00:01")]
    events = spark.createDataFrame(rows, "event_id int, canonical_customer_id string, device_cookie string, event_type string, t string").select(
        "*", F.to_timestamp("t").alias("event_ts"), F.lit("p").alias("page_url"), F.lit(None).cast("string").alias("utm_source")
    )
    found, placed = metrics.sessionise(events)
    assert sorted(r["event_count"] for r in found.collect()) == [2, 2]
    assert placed.select("session_id").distinct().count() == 2


def walked(events, gap):
    """Session numbers and starts, event by event."""
    out, last, seq = {}, {}, {}
    for e in sorted(events, key=lambda e: (e[1] or "", e[2], e[4] is not None, e[4] or 0, e[0])):
        key = e[1:3]
        new = key not in last or last[key] is None or e[4] - last[key] > gap * 60
        seq[key] = seq.get(key, 0) + new
        last[key] = e[4]
        out[e[0]] = (key, seq[key])
    return out


@pytest.mark.parametrize("piece", [200, 37])
def test_sessions_of_one_busy_cookie_are_those_of_a_walk(spark, piece):
    """Nine events of ten are of one cookie: they are scanned in many slices, and sessions that go on over borders are one."""
    rng, t, rows = random.Random(piece), 1_700_000_000, []
    for i in range(1500):
        t += rng.choice([0, 5, 60, 1799, 1800, 1801, 9000])
        busy = rng.random() < 0.9
        rows.append((i, None if busy else rng.choice(["u", None]), "hot" if busy else rng.choice("ab"), "view", t))
    rows += [(2000 + i, None, "hot", "view", None) for i in range(3)] + [(3000 + i, None, "hot", "purchase", t) for i in range(150)]
    events = spark.createDataFrame(rows, "event_id int, canonical_customer_id string, device_cookie string, event_type string, s long").select(
        "*", F.timestamp_seconds("s").alias("event_ts"), F.lit("p").alias("page_url"), F.lit(None).cast("string").alias("utm_source")
    )
    sessions, placed = metrics.sessionise(events, piece=piece)
    want = walked(rows, 30)
    assert {int(r["event_id"]): r["session_id"] for r in placed.select("event_id", "session_id").collect()} == {
        i: hashlib.sha256(f"{k[0] or 'anon'}:{k[1]}:{n}".encode()).hexdigest() for i, (k, n) in want.items()
    }
    assert sessions.count() == len(set(want.values()))
    cut, several = scan.sliced(events, ["canonical_customer_id", "device_cookie"], "event_ts", piece)
    assert several and max(Counter(r[0] for r in cut.where("device_cookie = 'hot'").select(scan.SLICE).collect()).values()) <= 150 + 2 * piece


def test_orders_of_one_busy_customer_look_back_over_slices(spark):
    rng = random.Random(2)
    rows = [(i, "big" if i % 10 else f"c{i % 40}", rng.randrange(400), 5) for i in range(600)] + [(900, None, 3, 1), (901, "big", None, 1)]
    orders = spark.createDataFrame(rows, "order_id int, canonical_customer_id string, day int, g int").select(
        "order_id", "canonical_customer_id", "day", F.when(F.col("day").isNotNull(), F.timestamp_seconds(F.col("day") * 86400 + F.col("order_id"))).alias("order_ts"), F.lit("sale").alias("order_type"),
        *[F.col("g").cast("decimal(14,2)").alias(c) for c in ("gross_amount", "discount_amount", "shipping_amount", "tax_amount")],
    )
    find = lambda piece: sorted(metrics.enrich_orders(orders, piece).select("order_id", "is_first_order", "days_since_previous_order", "net_amount").collect())
    assert find(40) == find(None) == find(7)
    assert sum(r["is_first_order"] for r in find(40)) == len({r[1] for r in rows if r[1]})


def test_substrings_are_found_by_their_grams(spark, tmp_path):
    rng = random.Random(6)
    names = ["".join(rng.choice("aAbé ") for _ in range(rng.randrange(0, 12))) for _ in range(150)] + [None, "", "ab", "a", "aaaaaaa", "x\x00y"]
    rows = [(i % 140, n, rng.choice([None, "Ab@x", "b"])) for i, n in enumerate(names)]
    docs = spark.createDataFrame(rows, "id int, name string, mail string")
    index = textindex.write(textindex.postings(docs, "id", ["name", "mail"]), str(tmp_path / "index"))
    for q in ("a", "AB", "aab", "abAé", "a a", "aaaaaaa", "aaaaaaaa", "b@", "@x", "ab@x", "zz", "zzz", "12", "139", " ", "é", ""):
        want = {str(i) for i, *cells in rows if str(i) == q or any(c is not None and q.lower() in c.lower() for c in cells)}
        got = [r["key"] for r in textindex.find(index, q).collect()]
        assert len(got) == len(set(got)) and set(got) == want, q
    assert {r["id"] for r in textindex.search(index, docs, "id", "ab@x").collect()} == {i for i, _, m in rows if m == "Ab@x"}
    plan = textindex.find(index, "ab@x")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(gram,b@x)" in plan and "customers" not in plan
    assert "StringStartsWith(gram,b@)" in textindex.find(index, "b@")._jdf.queryExecution().executedPlan().toString()


def test_indexed_neighbours_are_those_of_all_pairs(spark):
    """Groups around a few directions, copies, ties, zeros, nulls and two lengths; most rows are passed over."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] + 0.05 * rng.normal(size=8)).tolist()) for i in range(1500)] + [(2000 + i, centres[0].tolist()) for i in range(300)]
    rows += [(3000, [0.0] * 8), (3001, None), (3002, []), (3003, [1.0, None] + [0.0] * 6), (None, centres[1].tolist())] + [(4000 + i, [1.0, float(i), 2.0]) for i in range(6)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = vectors.where("vec_id % 97 = 0 or vec_id = 2000 or vec_id = 4002 or vec_id = 3000")
    index = vectorindex.build(vectors)
    for k, floor in ((40, 0.9), (400, None)):
        want = retrieval.nearest_each(asked, vectors, k, floor=floor)
        assert sorted(vectorindex.nearest_indexed(index, asked, k, floor).collect()) == sorted(want.collect())
    q = vectorindex._usable(asked, "vec_id", "embedding", 8).withColumn("least", F.lit(0.9))
    compared = vectorindex.probes(index, q, 5).groupBy("k").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0]
    assert compared < 0.4 * 1800 and index.units["n"].sum() == 1800
    assert vectorindex.build(vectors.where("vec_id >= 3001 and vec_id <= 3002")) is None


def test_queries_of_an_index_are_never_broadcast(spark, monkeypatch):
    """A query went to each unit with its vector, and the whole of that was taken for small and sent through the driver; it goes to a slab once."""
    rng = np.random.default_rng(5)
    vectors = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(1200)], "vec_id long, embedding array<double>")
    index = vectorindex.build(vectors)
    asked = vectorindex._usable(vectors.where("vec_id % 20 = 0"), "vec_id", "embedding", 8).withColumn("least", F.lit(-1.0))
    sent = vectorindex.probes(index, asked, 10).drop("n")
    monkeypatch.setattr(vectorindex, "durable", lambda df: df)
    plan = vectorindex._compared(index, sent, 10, None)._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"Join \[([a-z_]+)#", plan)) <= {"cell"} and "BroadcastNestedLoopJoin" not in plan
    assert index.slabs > 1 and sent.count() == sent.select("k", "slab").distinct().count() == 60 * index.slabs


def test_vectors_meet_queries_as_single_rows_in_bounded_slabs(spark, monkeypatch):
    """Pairs of whole blocks of queries and vectors were rows, so a batch of rows had no bound."""
    monkeypatch.setattr(retrieval, "SLAB", 300)
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(1500, 4)), 1)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = retrieval.nearest_each(vectors.where("vec_id % 50 = 0"), vectors, 7)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], -r["score"], r["vec_id"])):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=True))
    rows = x.tolist()
    norm = [dot(v, v) ** 0.5 for v in rows]
    for q in range(0, 1500, 50):
        score = {i: dot(rows[q], v) / (norm[q] * norm[i]) for i, v in enumerate(rows) if norm[i]}
        assert got[q] == sorted(score, key=lambda i: (-score[i], i))[:7], q


def test_tasks_of_matching_grow_in_number_with_their_rows(spark, monkeypatch):
    """The number of tasks was the session's, so each grew with the tables."""
    tasks = lambda df: {int(n) for n in re.findall(r"hashpartitioning\(.*?, (\d+)\), REPARTITION_BY_NUM", df._jdf.queryExecution().executedPlan().toString())}
    monkeypatch.setattr(identity, "TASK_RECORDS", 20)
    monkeypatch.setattr(identity, "TASK_PAIRS", 20)
    value = lambda i: "hot" if i < 60 else f"v{i // 4}"
    people = spark.createDataFrame([(i, value(i)) for i in range(200)], "id int, mail string")
    ids = identity.identifiers(people, "crm", "id", {"email": F.col("mail")})
    edges = identity.match(identity.screen(ids), most=50)
    assert tasks(edges) == {1 + 200 // 20, 1 + 200 // 20 + 35 * 6 // 20}
    least = {}
    for r in identity.clusters(identity.record_keys(ids), edges).collect():
        least.setdefault(value(int(r["source_record_key"][4:])), set()).add(r["cluster_key"])
    assert len(least) == 36 and all(len(keys) == 1 for keys in least.values()) and len(set.union(*least.values())) == 36


def test_a_basket_of_everything_is_paired_in_tiles(spark):
    rng = random.Random(9)
    rows = [("all", p) for p in range(90)] + [(f"o{i}", rng.randrange(120)) for i in range(40) for _ in range(5)] + [("o1", 3), ("o1", 3)]
    lines = spark.createDataFrame(rows, "order_id string, product_id int")
    baskets = {}
    for o, p in rows:
        baskets.setdefault(o, set()).add(p)
    want = Counter(pair for b in baskets.values() for pair in combinations(sorted(b), 2))
    basket = lines.distinct()
    assert Counter(map(tuple, serving.basket_pairs(basket, tile=10).collect())) == want
    found = {(r["product_a"], r["product_b"]): r["orders_together"] for r in serving.co_purchase(lines, 2, tile=10).collect()}
    assert found == {p: n for p, n in want.items() if n >= 2}


def test_a_merge_rewrites_the_folders_of_its_keys_alone(spark, tmp_path):
    path = tmp_path / "t"
    sinks.write_keyed(spark.createDataFrame([(i, "old") for i in range(300)] + [(None, "old")], "k int, v string"), str(path), ["k"], 16)
    before = {p: p.stat().st_mtime_ns for p in path.rglob("*.parquet")}
    assert sinks.merge_keyed(spark, str(path), spark.createDataFrame([("new", 7), ("new", 999), ("new", None)], "v string, k int"), ["k"], buckets=16) <= 3
    after = {p: p.stat().st_mtime_ns for p in path.rglob("*.parquet")}
    same = {p for p in before if after.get(p) == before[p]}
    assert len(before) == 16 and len(same) >= 13
    assert {tuple(r) for r in sinks.read_keyed(spark, str(path)).select("k", "v").collect()} == {(i, "new" if i == 7 else "old") for i in range(300)} | {(None, "new"), (999, "new")}
    assert sinks.merge_keyed(spark, str(path), spark.createDataFrame([], "k int, v string"), ["k"], buckets=16) == 0


def test_windows_merged_from_days_estimate_visitors_and_medians(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), f"2024-01-{rng.randrange(1, 29):02}", rng.randrange(900), rng.gauss(50, 9)) for _ in range(6000)]
    events = spark.createDataFrame(rows, "kind string, day string, who int, x double").select("kind", F.to_timestamp("day").alias("at"), "who", "x")
    found = bitmaps.windows(bitmaps.daily_partials(events, ["kind"], "at", "who", "x"), ["kind"], F.lit("2024-01-28").cast("date"), (1, 7, 28)).collect()
    assert len(found) == 6
    for r in found:
        own = [(w, x) for k, d, w, x in rows if k == r["kind"] and int(d[-2:]) > 28 - r["days"]]
        assert r["events"] == len(own) and abs(r["visitors"] / len({w for w, _ in own}) - 1) < 0.05
        below = sum(x < r["median"] for _, x in own) / len(own)
        assert abs(below - 0.5) < 0.05


def test_memberships_over_several_stretches(spark):
    rows = [("s", d, n) for d, n in [(1, 0), (1, 40_000), (1, 70_000), (1, 70_000), (2, 0), (2, 40_001), (4, 32_767), (4, 32_768)]] + [("t", 2, 5)]
    df = spark.createDataFrame(rows, "segment string, d int, number long").withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), F.col("d") - 1))
    found = bitmaps.daily_changes(bitmaps.membership(df, ["segment", "day"]), ["segment"])
    got = {(r["segment"], r["day"].day): (r["members"], r["entered"], r["exited"]) for r in found.collect()}
    assert got == {("s", 1): (3, 3, 0), ("s", 2): (2, 1, 2), ("s", 3): (0, 0, 2), ("s", 4): (2, 2, 0), ("s", 5): (0, 0, 2), ("t", 2): (1, 1, 0), ("t", 3): (0, 0, 1)}
    keys = bitmaps.numbered(spark.createDataFrame([("b",), ("a",), (None,), ("b",), ("c",)], "k string"), "k")
    assert dict(map(tuple, keys.collect())) == {"a": 0, "b": 1, "c": 2}
