import pytest
from pyspark.sql import functions as F

from tickloom.operators.quality import check_payloads
from tickloom.sources import snapshots as sn

DEFAULTS = {"weights": {"normal": {"flow": 0.25, "value": 0.1}}, "limit": 3, "mode": "fast", "strict": True}


def effective(spark, folder, depth=8):
    given = sn.flatten_parameters(sn.read_parameter_files(spark, f"file://{folder}"), depth)
    return {r["path"]: (r["number"], r["text"], r["status"]) for r in sn.nested_parameters(spark, DEFAULTS, given).collect()}


def test_files_over_defaults(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"weights": {"normal": {"flow": 0.5, "other": [1, 2]}}, "limit": "many", "mode": "slow"}')
    (tmp_path / "b.json").write_text('{"weights": {"normal": {"flow": 0.75}}, "strict": false, "deep": {"er": {"key": 7}}, "none": {}}')
    (tmp_path / "c.json").write_text("{not json")
    assert effective(spark, tmp_path) == {
        "weights.normal.flow": (0.75, None, "given"), "weights.normal.value": (0.1, None, "default"), "weights.normal.other": (None, "[1,2]", "unknown"),
        "limit": (3.0, None, "wrong type"), "mode": (None, "slow", "given"), "strict": (None, "false", "given"), "deep.er.key": (7.0, None, "unknown")}


def test_without_files_and_too_deep(spark, tmp_path):
    (tmp_path / "a.json").write_text("{}")
    assert {k: v[2] for k, v in effective(spark, tmp_path).items()} == dict.fromkeys(sn.key_paths(DEFAULTS), "default")
    (tmp_path / "a.json").write_text('{"a": {"b": {"c": 1}}}')
    assert effective(spark, tmp_path, 3)["a.b.c"] == (1.0, None, "unknown")
    with pytest.raises(Exception, match="too deep"):
        effective(spark, tmp_path, 2)


def test_payload_reasons(spark):
    cases = {
        None: (None, "null"), "<html>": (None, "html"), "busy": (None, "text"), '{"Error": 1}': (None, "error"), "[]": (0, None), '{"data": []}': (0, None),
        '[{"a": 1, "b": "x"}]': (1, None), '{"data": [{"a": 1}, {"a": null}]}': (2, "null: a"), '[{"b": 1}]': (1, "null: a"), '[{"_a": 1}]': (1, "unexpected fields"),
        '{"_a": 1}': (1, "null: a"), "[1, 2]": (None, "malformed"), '[{"a": 1}': (None, "malformed"), '[{}]': (1, "unexpected fields")}
    df = spark.createDataFrame([(i, p) for i, p in enumerate(cases)], "i int, p string")
    got = {r["i"]: (r["n_records"], r["reason"]) for r in check_payloads(df, "p", ["a"]).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    assert check_payloads(df, "p").where(F.col("reason").startswith("null:")).count() == 0
