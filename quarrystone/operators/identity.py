"""Identity resolution: identifiers, screening, matching, clusters, guards, canonical ids and their evaluation.

A record is ``source_system:source_record_id``. Records that share an identifier are joined by an edge with a rule and a confidence; connected records are a
customer. Guards cut edges that are too weak or make clusters too large, and ids persist over runs.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clean
from ..plans.components import connected_components, updated_components
from ..plans.durable import durable
from ..plans.forest import best_forest, last_step_that_fits

#: Identifiers and local parts of e-mail addresses that name nobody.
DENIED_VALUES = ["0000000000", "9999999999", "1234567890", "+910000000000", "test@test.com", "n/a@n/a.com"]
DENIED_LOCALS = ["info", "admin", "support", "noreply", "no-reply", "sales", "contact", "help", "billing", "hello", "office"]
#: Records and pairs of a task, about, and the parts of a frequent value.
TASK_RECORDS, TASK_PAIRS, PARTS = 100_000, 200_000, 8


@dataclass(frozen=True)
class Settings:
    """Limits of screening, guards, and the rules' confidences."""

    max_records: int = 8
    max_names: int = 3
    merge_confidence: float = 0.75
    max_cluster_size: int = 50
    authoritative: tuple[str, ...] = ("crm_id", "loyalty_id", "app_user_id")
    confidence_id: float = 1.00
    confidence_email: float = 0.95
    confidence_phone: float = 0.80
    confidence_phone_and_name: float = 0.92


def identifiers(df: DataFrame, system: str, record: str, namespaces: dict[str, Column]) -> DataFrame:
    """``(source_system, source_record_id, identity_namespace, identity_value_norm)``; null and blank values go."""
    pairs = F.array(*[F.struct(F.lit(n).alias("identity_namespace"), c.cast("string").alias("identity_value_norm")) for n, c in namespaces.items()])
    rows = df.select(F.lit(system).alias("source_system"), F.col(record).cast("string").alias("source_record_id"), F.inline(pairs))
    return rows.where(F.trim("identity_value_norm") != "")


def person_identifiers(crm: DataFrame, loyalty: DataFrame, app: DataFrame) -> DataFrame:
    """Ids, e-mails and phones of the three person sources, after cleaning."""
    own = lambda c: clean.authoritative_id(F.col(c))
    parts = [
        identifiers(df, system, record, {ns: own(record), "email": F.col("email_norm"), "phone": F.col("phone_norm")})
        for df, system, record, ns in ((crm, "crm", "crm_customer_id", "crm_id"), (loyalty, "loyalty", "loyalty_id", "loyalty_id"), (app, "app", "app_user_id", "app_user_id"))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def screen(ids: DataFrame, attrs: DataFrame | None = None, cfg: Settings = Settings()) -> DataFrame:
    """``ids`` with value_hash, value_masked, ``screen_reason`` (null if usable) and is_screened.

    Reasons, the first that holds: S1 denied value, S2 generic e-mail, S3 too many records over two or more sources, S5 one
    digit repeated seven times or more, S4 a phone of too many full names (with ``attrs``). Counts are grouped and joined
    back, so a frequent identifier costs no list.
    """
    keyed = ids.withColumns({
        "value_hash": clean.value_hash(F.col("identity_namespace"), F.col("identity_value_norm")),
        "value_masked": clean.masked_value(F.col("identity_value_norm")),
    })
    seen = keyed.groupBy("identity_namespace", "value_hash").agg(
        F.count_distinct("source_system", "source_record_id").alias("__records"), F.count_distinct("source_system").alias("__sources")
    )
    out = keyed.join(seen, ["identity_namespace", "value_hash"])
    if attrs is not None:
        named = keyed.where("identity_namespace = 'phone'").join(attrs.select("source_system", "source_record_id", "full_name_norm"), ["source_system", "source_record_id"])
        names = named.groupBy("identity_namespace", "value_hash").agg(F.count_distinct("full_name_norm").alias("__names"))
        out = out.join(names, ["identity_namespace", "value_hash"], "left")
    else:
        out = out.withColumn("__names", F.lit(0))
    value = F.col("identity_value_norm")
    digits = F.regexp_replace(value, r"\D", "")
    local = F.regexp_extract(value, "^([^@]+)@", 1)
    reason = (
        F.when(F.lower(value).isin(DENIED_VALUES), "S1_static_denylist")
        .when((F.col("identity_namespace") == "email") & F.lower(local).isin(DENIED_LOCALS), "S2_generic_email")
        .when((F.col("__records") > cfg.max_records) & (F.col("__sources") >= 2), "S3_frequency_threshold")
        .when(digits.rlike(r"^(\d)\1{6,}$"), "S5_implausible_value")
        .when(F.col("__names") > cfg.max_names, "S4_phone_name_conflict")
    )
    return out.withColumn("screen_reason", reason).withColumn("is_screened", F.col("screen_reason").isNotNull()).drop("__names").withColumnsRenamed(
        {"__records": "record_count", "__sources": "source_count"}
    )


def screened_log(screened: DataFrame) -> DataFrame:
    return screened.where("is_screened").groupBy("identity_namespace", "value_hash", "value_masked", "screen_reason").agg(
        F.count_distinct("source_system", "source_record_id").alias("records"), F.count_distinct("source_system").alias("sources")
    )


def _stars(hot: DataFrame, tasks: int) -> tuple[DataFrame, DataFrame]:
    """(a, b) pairs of records of frequent values that join the same records as all pairs do, by phone and agreeing names where possible.

    Records of one value that agree in surname and initial hang on the least of them, and those on the value's least record. The records of a value
    are dealt over several tasks, to each of which the least goes.
    """
    value = ["identity_namespace", "value_hash"]
    named = F.col("last").isNotNull() & F.col("first").isNotNull()
    grouped = hot.withColumn("__names", F.when(named, F.concat_ws(":", "last", F.left("first", F.lit(1)))))
    columns = ["record", "value_masked", "first", "last"]
    least = lambda df, by: df.groupBy(*by).agg(F.min_by(F.struct(*columns), "record").alias("c")).select(*by, "c.*")
    inner = least(grouped.where("__names is not null"), [*value, "__names"])
    heads = inner.select(*value, *columns).unionByName(grouped.where("__names is null").select(*value, *columns))
    tops = least(heads, value)
    on = lambda by: reduce(Column.__and__, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in by]) & (F.col("a.record") < F.col("b.record"))
    every = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))
    part = F.pmod(F.xxhash64("record"), F.lit(PARTS)).cast("int")

    def hung(least: DataFrame, records: DataFrame, by: list[str]) -> DataFrame:
        a, b = (df.withColumn("__part", c).repartition(tasks, *by, "__part") for df, c in ((least, every), (records, part)))
        return a.alias("a").join(b.alias("b"), on([*by, "__part"]))

    return hung(inner, grouped, [*value, "__names"]), hung(tops, heads, value)


def match(screened: DataFrame, attrs: DataFrame | None = None, cfg: Settings = Settings(), most: int = 1000) -> DataFrame:
    """The best edge of each pair of records that share a usable identifier: (record_a, record_b, rule_id, confidence, namespace, value_masked).

    One self-join serves all rules: ids R-01, e-mails R-02, phones R-03, or R-04 where the surnames agree and the first
    names or their initials do. Ties go to the smaller rule, namespace and value. A value of more than ``most`` records that the screen let
    pass (all of one source) is not expanded into all pairs: its records hang on the least ones, so components are the same.
    """
    rows = screened.where("not is_screened").select(
        F.concat_ws(":", "source_system", "source_record_id").alias("record"), "source_system", "source_record_id", "identity_namespace", "value_hash", "value_masked"
    ).where(F.col("identity_namespace").isin("email", "phone", *cfg.authoritative))
    if attrs is not None:
        names = attrs.select("source_system", "source_record_id", F.col("first_name_norm").alias("first"), F.col("last_name_norm").alias("last"))
        rows = rows.join(names, ["source_system", "source_record_id"], "left")
    else:
        rows = rows.withColumns({"first": F.lit(None).cast("string"), "last": F.lit(None).cast("string")})
    rows = durable(rows.select("record", "identity_namespace", "value_hash", "value_masked", "first", "last"))
    value = ["identity_namespace", "value_hash"]
    counts = durable(rows.groupBy(*value).agg(F.count("*").alias("__n")))
    frequent = counts.where(F.col("__n") > most).drop("__n")
    n = F.col("__n")
    total = counts.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("records"), F.coalesce(F.sum(F.when(n <= most, n * (n - 1) / 2)), F.lit(0)).cast("long").alias("pairs")).first()
    tasks = 1 + total["records"] // TASK_RECORDS + total["pairs"] // TASK_PAIRS
    dealt = rows.repartition(tasks, *value)  # so many that a task's sorts stay small, however large the table
    near, far = _stars(rows.join(frequent, value, "left_semi"), 1 + total["records"] // TASK_RECORDS)
    few = dealt.join(frequent, value, "left_anti")
    a, b = few.alias("a"), few.alias("b")
    pairs = a.join(b, (F.col("a.identity_namespace") == F.col("b.identity_namespace")) & (F.col("a.value_hash") == F.col("b.value_hash")) & (F.col("a.record") < F.col("b.record")))
    ends = lambda df: df.select(*[F.struct(*[f"{s}.{c}" for c in rows.columns]).alias(s) for s in "ab"])
    pairs = ends(pairs).unionByName(ends(near)).unionByName(ends(far))
    initial = F.left(F.col("a.first"), F.lit(1)) == F.left(F.col("b.first"), F.lit(1))
    agree = F.coalesce((F.col("a.last") == F.col("b.last")) & ((F.col("a.first") == F.col("b.first")) | initial), F.lit(False))
    ns = F.col("a.identity_namespace")
    phone = ns == "phone"
    rule = F.when(phone & agree, "R-04").when(phone, "R-03").when(ns == "email", "R-02").otherwise("R-01")
    sure = (
        F.when(phone & agree, cfg.confidence_phone_and_name).when(phone, cfg.confidence_phone).when(ns == "email", cfg.confidence_email).otherwise(cfg.confidence_id)
    )
    edges = pairs.select(F.col("a.record").alias("record_a"), F.col("b.record").alias("record_b"), F.struct((-sure).alias("c"), rule.alias("r"), ns.alias("n"), F.col("a.value_masked").alias("m")).alias("e"))
    best = edges.groupBy("record_a", "record_b").agg(F.min("e").alias("e"))
    return best.select("record_a", "record_b", F.col("e.r").alias("rule_id"), (-F.col("e.c")).alias("confidence"), F.col("e.n").alias("namespace"), F.col("e.m").alias("value_masked"))


def clusters(records: DataFrame, edges: DataFrame) -> DataFrame:
    """``(source_record_key, cluster_key)`` for every record; the key is the cluster's least record."""
    found = connected_components(edges, "record_a", "record_b")
    every = records.select("source_record_key").distinct()
    return every.join(found, every["source_record_key"] == found["vertex"], "left").select("source_record_key", F.coalesce("component", "source_record_key").alias("cluster_key"))


def edge_changes(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(added, removed) pairs of records, however often and by whatever rule they are joined."""
    pair = ["record_a", "record_b"]
    old, new = (df.select(*pair).distinct() for df in (before, after))
    return new.join(old, pair, "left_anti"), old.join(new, pair, "left_anti")


def updated_clusters(found: DataFrame, records: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """What ``clusters(records, after)`` gives, from the clusters ``found`` of an earlier run and its edges ``before``; clusters without a change are kept as they are.

    New records and edges join clusters, and edges that are gone (as an identifier has become too frequent) part them. Records that are gone must have lost their edges.
    """
    added, removed = edge_changes(before, after)
    labels = found.select(F.col("source_record_key").alias("vertex"), F.col("cluster_key").alias("component"))
    now = updated_components(labels, after, durable(added), durable(removed), "record_a", "record_b")
    every = records.select("source_record_key").distinct()
    return every.join(now, every["source_record_key"] == now["vertex"], "left").select("source_record_key", F.coalesce("component", "source_record_key").alias("cluster_key"))


def record_keys(ids: DataFrame) -> DataFrame:
    return ids.select(F.concat_ws(":", "source_system", "source_record_id").alias("source_record_key")).distinct()


def review_members(found: DataFrame, review: DataFrame) -> DataFrame:
    """``(candidate_cluster_key, source_record_key)``: the members of clusters under review, a row each, however many they are."""
    return found.withColumnRenamed("cluster_key", "candidate_cluster_key").join(review.select("candidate_cluster_key"), "candidate_cluster_key", "left_semi").select("candidate_cluster_key", "source_record_key")


def _too_large(large: DataFrame, limit: int) -> DataFrame:
    """``large`` with ``cut`` set on the edges that have to go so that no part of a cluster has more than ``limit`` records.

    Steps come by falling confidence and, of one confidence, by the larger record: a record comes in with all its edges to smaller ones. So
    the parts of a step depend on who is connected, not on which edges say so, and a maximum spanning forest has the same.
    """
    steps = large.withColumns({"__less": -F.col("confidence"), "__late": F.greatest("record_a", "record_b")})
    forest = best_forest(steps, "record_a", "record_b", [F.col("__less"), F.col("__late")], ["cluster_key", "__less", "__late"])
    last = last_step_that_fits(forest, "cluster_key", "record_a", "record_b", ["__less", "__late"], limit)
    last = last.select("cluster_key", F.struct("__less", "__late").alias("__last"))
    kept = F.struct("__less", "__late") <= F.col("__last")
    return steps.join(last, "cluster_key", "left").withColumn("cut", F.when(~F.coalesce(kept, F.lit(False)), "cluster_too_large")).select(*large.columns)


def guard(found: DataFrame, edges: DataFrame, cfg: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """Clusters after the guards, and the review rows (candidate_cluster_key, reason, cut_edges, min_edge_confidence) of clusters that lost edges.

    Two records joined by one phone edge alone are parted (attribute_conflict); edges below the merge confidence go
    (low_confidence_merge); of a cluster above the size limit the weakest edges go until its parts fit (cluster_too_large): edges are
    kept by falling confidence, and of one confidence record by record in the order of the larger end, up to the first record whose edges make
    too large a part. Which of several edges connect the same records makes no difference. Only clusters that lose edges are
    clustered anew. ``review_members`` gives the members of clusters under review.
    """
    sizes = found.groupBy("cluster_key").agg(F.count("*").alias("size"))
    placed = edges.join(found.withColumnRenamed("source_record_key", "record_a"), "record_a")
    counts = placed.groupBy("cluster_key").agg(F.count("*").alias("n_edges"), F.min("confidence").alias("min_edge_confidence"))
    info = sizes.join(counts, "cluster_key")
    alone = (F.col("size") == 2) & (F.col("n_edges") == 1) & (F.col("rule_id") == "R-03")
    marked = placed.join(info, "cluster_key").withColumn(
        "cut", F.when(alone, "attribute_conflict").when(F.col("confidence") < cfg.merge_confidence, "low_confidence_merge")
    ).select("cluster_key", "record_a", "record_b", "rule_id", "confidence", "cut", "size", "min_edge_confidence")
    marked = durable(marked.where(F.col("cut").isNotNull() | (F.col("size") > cfg.max_cluster_size) | (F.col("min_edge_confidence") < cfg.merge_confidence)))
    oversized = F.col("cut").isNull() & (F.col("size") > cfg.max_cluster_size)
    large = marked.where(oversized)
    decided = marked if large.isEmpty() else durable(marked.where(~oversized).unionByName(_too_large(large, cfg.max_cluster_size)))
    cuts = decided.where("cut is not null").groupBy("cluster_key").agg(
        F.when(F.min("cut") == F.max("cut"), F.min("cut")).otherwise("mixed").alias("reason"), F.count("*").alias("cut_edges"), F.min("min_edge_confidence").alias("min_edge_confidence")
    )
    cuts = durable(cuts)
    touched = found.join(cuts, "cluster_key", "left_semi").select("source_record_key")
    again = clusters(touched, decided.where("cut is null").join(cuts, "cluster_key", "left_semi"))
    after = found.join(cuts, "cluster_key", "left_anti").select("source_record_key", "cluster_key").unionByName(again)
    return after, cuts.withColumnRenamed("cluster_key", "candidate_cluster_key")


def minted(cluster_key: Column) -> Column:
    return F.concat(F.lit("CX"), F.left(F.sha2(cluster_key, 256), F.lit(16)))


def canonical(found: DataFrame, prior: DataFrame, run_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(assignment, crosswalk, audit) of this run's clusters given ``prior(source_record_key, prior_id, first_seen_run)``.

    A prior id stays with the cluster that holds most of its records (ties: smaller key); a cluster that several ids
    stay with keeps the one of most records, then the earliest, then the smallest, and the others are merged into it; a
    cluster without one gets a new id from its key. The crosswalk has a row for every current, merged and split id.
    """
    held = found.join(prior, "source_record_key").groupBy("prior_id", "cluster_key").agg(F.count("*").alias("n"), F.min("first_seen_run").alias("first_seen_run"))
    w = Window.partitionBy("prior_id")
    held = held.withColumns({"place": F.row_number().over(w.orderBy(F.desc("n"), "cluster_key")), "parts": F.count("*").over(w)})
    stay = held.where("place = 1")
    order = Window.partitionBy("cluster_key").orderBy(F.desc("n"), "first_seen_run", "prior_id")
    stay = stay.withColumns({"rank": F.row_number().over(order), "survivor": F.first("prior_id").over(order)})
    kept = stay.where("rank = 1").select("cluster_key", F.col("prior_id").alias("kept_id"), F.col("first_seen_run").alias("kept_run"))
    keys = found.select("cluster_key").distinct().join(kept, "cluster_key", "left")
    named = keys.select("cluster_key", F.coalesce("kept_id", minted(F.col("cluster_key"))).alias("canonical_customer_id"), F.coalesce("kept_run", F.lit(run_id)).alias("first_seen_run_id"))
    assignment = found.join(named.select("cluster_key", "canonical_customer_id"), "cluster_key").select("source_record_key", "cluster_key", "canonical_customer_id")
    none = F.lit(None).cast("int")
    current = named.select(F.col("canonical_customer_id").alias("prior_canonical_customer_id"), "canonical_customer_id", F.lit("current").alias("status"), "first_seen_run_id", none.alias("merged_in_run_id"))
    merged = stay.where("rank > 1").select(
        F.col("prior_id").alias("prior_canonical_customer_id"), F.col("survivor").alias("canonical_customer_id"), F.lit("merged").alias("status"),
        F.col("first_seen_run").alias("first_seen_run_id"), F.lit(run_id).alias("merged_in_run_id"),
    )
    split = held.where("parts > 1 and place > 1").join(named, "cluster_key").select(
        F.col("prior_id").alias("prior_canonical_customer_id"), "canonical_customer_id", F.lit("split").alias("status"),
        F.col("first_seen_run").alias("first_seen_run_id"), none.alias("merged_in_run_id"),
    )
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    splits = held.where("parts > 1").groupBy("prior_id").agg(joined("cluster_key").alias("related")).select(
        F.lit("cluster_split").alias("event"), F.col("prior_id").alias("canonical_customer_id"), F.col("related").alias("related_canonical_ids")
    )
    merges = stay.where("rank > 1").groupBy("survivor").agg(joined("prior_id").alias("related")).select(
        F.lit("cluster_merged").alias("event"), F.col("survivor").alias("canonical_customer_id"), F.col("related").alias("related_canonical_ids")
    )
    return assignment, current.unionByName(merged).unionByName(split), splits.unionByName(merges)


def resolve(asked: DataFrame, crosswalk: DataFrame, column: str = "customer_id") -> DataFrame:
    """``asked`` with ``resolved_id`` and ``outcome``: found, merged (one step on), split or unknown."""
    one = crosswalk.groupBy("prior_canonical_customer_id").agg(
        F.min(F.when(F.col("status") == "current", F.col("canonical_customer_id"))).alias("now"),
        F.min(F.when(F.col("status") == "merged", F.col("canonical_customer_id"))).alias("next"),
        F.max((F.col("status") == "split").cast("int")).alias("parted"),
    )
    out = asked.join(one, asked[column] == one["prior_canonical_customer_id"], "left")
    outcome = F.when(F.col("now").isNotNull(), "found").when(F.col("next").isNotNull(), "merged").when(F.col("parted") == 1, "split").otherwise("unknown")
    return out.select(*asked.columns, F.coalesce("now", "next").alias("resolved_id"), outcome.alias("outcome"))


def golden_records(attrs: DataFrame, priority: dict[str, int], per_field: bool = False) -> DataFrame:
    """One row a customer: the whole row of the source with the least priority number (ties: smaller record), or the first value of each field."""
    rank = F.element_at(F.create_map(*(F.lit(x) for pair in priority.items() for x in pair)), F.col("source_system"))
    fields = [c for c in attrs.columns if c not in ("canonical_customer_id", "source_system", "source_record_id")]
    order = F.struct(rank.alias("p"), F.col("source_record_id").alias("r"))
    if per_field:
        picks = [F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in fields]
    else:
        best = F.min_by(F.struct(*fields), order)
        picks = [best[c].alias(c) for c in fields]
    return attrs.groupBy("canonical_customer_id").agg(*picks, F.count_distinct("source_system").alias("source_system_count"))


def order_references(orders: DataFrame, ref: str = "customer_ref", kind: str = "customer_ref_type") -> DataFrame:
    """Adds ref_namespace and ref_value_norm, by the given type or, without one, by the look of the reference."""
    c = F.col(ref)
    guess = F.coalesce(F.col(kind), F.when(c.rlike("^[Cc][0-9]{6}$"), "crm_id").when(c.rlike("^[Uu][0-9A-Za-z]{8,}$"), "app_user_id"))
    ns = F.when(guess.isin("crm_id", "app_user_id"), guess).otherwise("email")
    return orders.withColumn("ref_namespace", ns).withColumn("ref_value_norm", F.when(ns == "email", F.lower(F.trim(c))).otherwise(F.upper(F.trim(c))))


def latest_orders(orders: DataFrame) -> DataFrame:
    """One row an order: the latest by updated_at_typed."""
    w = Window.partitionBy("order_id").orderBy(F.desc_nulls_last("updated_at_typed"), F.xxhash64(F.struct(*sorted(orders.columns))))
    return orders.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def attribute_orders(orders: DataFrame, ids: DataFrame, assignment: DataFrame) -> DataFrame:
    """Orders with canonical_customer_id (null if the reference is unknown); an identifier of several customers goes to the smallest id, so no order is doubled."""
    owned = ids.withColumn("source_record_key", F.concat_ws(":", "source_system", "source_record_id")).join(assignment, "source_record_key")
    lookup = owned.groupBy(F.col("identity_namespace").alias("ref_namespace"), F.col("identity_value_norm").alias("ref_value_norm")).agg(F.min("canonical_customer_id").alias("canonical_customer_id"))
    return orders.join(lookup, ["ref_namespace", "ref_value_norm"], "left")


def evaluate(truth: DataFrame, resolved: DataFrame) -> DataFrame:
    """Pairwise precision, recall, F1 and incidents from ``(source_record_key, true_id)`` and ``(source_record_key, cluster_key)``.

    Pairs are counted from group sizes, never made.
    """
    both = truth.join(resolved, "source_record_key").groupBy("true_id", "cluster_key").agg(F.count("*").alias("n"))
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2).cast("long")
    hit = both.agg(pairs("n").alias("tp"))
    true = both.groupBy("true_id").agg(F.sum("n").alias("n"), F.count("*").alias("parts")).agg(pairs("n").alias("true_pairs"), F.count_if(F.col("parts") > 1).alias("under_merges"))
    got = both.groupBy("cluster_key").agg(F.sum("n").alias("n"), F.count("*").alias("parts")).agg(pairs("n").alias("resolved_pairs"), F.count_if(F.col("parts") > 1).alias("over_merges"))
    one = hit.crossJoin(true).crossJoin(got)
    p, r = F.try_divide("tp", "resolved_pairs"), F.try_divide("tp", "true_pairs")
    one = one.withColumns({"precision": F.coalesce(p, F.lit(0.0)), "recall": F.coalesce(r, F.lit(0.0))})
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return one.withColumn("f1", f1)
