import pytest

from quarrystone.operators import identity, quality_rules, segments, views
from quarrystone.sources import config


def test_segments_and_rules_from_text(spark):
    text = '{"segments": [{"id": "A", "name": "Big", "rule_ast": {"op": ">=", "field": "order_count", "value": {"param": "n"}}, "thresholds": {"n": 3}}]}'
    found = config.segments(text)
    assert found[0].thresholds == {"n": 3} and found[0].null_handling == "exclude"
    segments.compile_rule(found[0].rule, found[0].thresholds)
    rules = config.rules('{"datasets": {"c": {"rules": [{"id": "R", "name": "n", "dimension": "validity", "type": "in_set", "severity": "reject", "column": "x", "values": ["a", "b"]}]}}}')
    assert rules["c"][0] == quality_rules.Rule("R", "n", "validity", "in_set", "reject", "x", args={"values": ("a", "b")})
    assert config.denied('{"email_local_parts": ["Info"], "values": ["000"]}') == (["000"], ["info"])


@pytest.mark.parametrize("text", ['[]', '{"c": []}', '{"datasets": {"c": []}}', '{"datasets": {"c": {"rules": [{"id": "R", "type": "unique"}]}}}', '{"datasets": {"c": {"rules": [{"id": "R", "dimension": "validity", "type": "no_such"}]}}}'])
def test_other_forms_of_rules_are_refused(text):
    with pytest.raises(ValueError):
        config.rules(text)


def test_yaml_where_its_parser_is_installed():
    pytest.importorskip("yaml")
    assert config.denied("local_parts: [info, sales]\nvalues:\n  - '0000'") == (["0000"], ["info", "sales"])


def test_tools_keep_to_roles(spark):
    tools = views.Tools("viewer", {"get_customer_profile": lambda k: spark.range(k), "get_customer_quality": lambda k: spark.range(k)})
    assert tools.call("get_customer_profile", 3).rows.count() == 3
    assert tools.call("get_customer_quality", 3).error == "requires analyst role or higher" and not tools.call("drop", 1).allowed


def test_frequent_values_are_joined_by_stars(spark):
    n = 300
    ids = spark.createDataFrame([("crm", str(i), "phone", "+919812345670") for i in range(n)], "source_system string, source_record_id string, identity_namespace string, identity_value_norm string")
    names = [("crm", str(i), "ann" if i % 3 else "bob", ["ray", "das", None][i % 5 % 3]) for i in range(n)]
    attrs = spark.createDataFrame(names, "source_system string, source_record_id string, first_name_norm string, last_name_norm string").selectExpr("*", "concat_ws(' ', first_name_norm, last_name_norm) as full_name_norm")
    usable = identity.screen(ids)
    stars, pairs = identity.match(usable, attrs, most=50), identity.match(usable, attrs)
    assert pairs.count() == n * (n - 1) // 2 and n - 1 <= stars.count() < 2 * n
    assert {r["rule_id"] for r in stars.collect()} == {"R-03", "R-04"}
    found = identity.clusters(identity.record_keys(ids), stars)
    assert found.count() == n and found.select("cluster_key").distinct().count() == 1
    assert stars.join(pairs.select("record_a", "record_b", "rule_id"), ["record_a", "record_b", "rule_id"], "left_anti").count() == 0


def test_dataset_result_has_scores_and_the_rules_hash(spark):
    rules = [quality_rules.Rule("A", "a", "validity", "not_null", "reject", "x"), quality_rules.Rule("B", "b", "uniqueness", "unique", "warn", columns=("k",))]
    r = views.dataset_result(spark.createDataFrame([(1, "a"), (1, None), (2, "b")], "k int, x string"), rules, "t", 9).first()
    assert (r["records_ingested"], r["records_rejected"], r["records_warned"], r["run_id"]) == (3, 1, 1, 9)
    assert r["score_validity"] == pytest.approx(66.67) and r["score_integrity"] is None and r["ruleset_hash"] == quality_rules.ruleset_hash(rules)
