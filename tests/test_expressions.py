"""Null rules and text rules of the column builders."""

import pytest
from pyspark.sql import functions as F

from hearthstat.functions import expressions as ex
from hearthstat.functions import keys as ky
from hearthstat.operators.scale import literal_table


def one(spark, column, **values):
    kinds = {int: "int", float: "double", str: "string"}
    items = {k: v if isinstance(v, tuple) else (v, kinds.get(type(v), "string")) for k, v in values.items()}
    ddl = ", ".join(f"{k} {kind}" for k, (_, kind) in items.items()) or "z int"
    rows = [tuple(v for v, _ in items.values()) or (0,)]
    return literal_table(spark, rows, ddl).select(column.alias("out")).first()[0]


@pytest.mark.parametrize("text, number", [
    ("12", 12.0), (" 12 ", 12.0), ("-3.5", -3.5), ("", None), ("  ", None), ("-", None), ("(X)", None), ("250,000+", None),
    ("1e5", None), ("+3", None), (".5", None), ("5.", None), (None, None), ("007", 7.0)])
def test_safe_number(spark, text, number):
    assert one(spark, ex.safe_number("t"), t=(text, "string")) == number


def test_safe_number_sentinels(spark):
    assert one(spark, ex.safe_number("t", [-666666666]), t="-666666666") is None
    assert one(spark, ex.safe_number("t"), t="-666666666") == -666666666.0


@pytest.mark.parametrize("num, den, want", [(1.0, 4.0, 25.0), (1.0, 0.0, None), (1.0, -2.0, None), (1.0, None, None), (None, 4.0, None)])
def test_pct(spark, num, den, want):
    assert one(spark, ex.pct("a", "b"), a=(num, "double"), b=(den, "double")) == want


def test_bundles_differ_when_nothing_is_known(spark):
    none = {"a": (None, "double"), "b": (None, "double")}
    assert one(spark, ex.bundle(["a", "b"]), **none) == 0.0
    assert one(spark, ex.bundle(["a", "b"], need_any=True), **none) is None
    assert one(spark, ex.bundle(["a", "b"], need_any=True), a=(None, "double"), b=2.0) == 2.0


def test_clamp_and_floor(spark):
    assert one(spark, ex.clamp("a", 0, 1), a=3.0) == 1.0
    assert one(spark, ex.clamp("a", 0, 1), a=(None, "double")) is None
    assert one(spark, ex.floored("a", 1), a=(None, "double")) == 1.0
    assert one(spark, ex.floored("a", 1), a=0.0) == 1.0


def test_rules_and_note(spark):
    rules = [(F.col("a") >= 40, "first thing"), (F.col("b") >= 2, "Second Thing")]
    assert one(spark, ex.first_rule(rules, "rest"), a=(None, "int"), b=5) == "Second Thing"
    assert one(spark, ex.rule_note(rules, "none."), a=50, b=5) == "First thing; second thing."
    assert one(spark, ex.rule_note(rules, "none."), a=(None, "int"), b=1) == "none."


def test_keys(spark):
    assert one(spark, ky.tract_number("n"), n="Census Tract 53.01; Some County; State") == "53.01"
    assert one(spark, ky.tract_number("n"), n="Census Tract 2, Some County, State") == "2"
    assert one(spark, ky.tract_number("n"), n="Block 7") is None
    assert one(spark, ky.name_part("n", 3), n="Census Tract 2; Some County; State") == "State"
    assert one(spark, ex.zero_padded("n", 3), n="7") == "007"
    assert one(spark, ex.zero_padded("n", 3), n="12345") == "12345"
    assert one(spark, ex.zero_padded("n", 3, digits_only=True), n="a7b") == "007"
    assert one(spark, ex.digits_of_length("n", 3), n=(None, "string")) is False


def test_names_and_labels(spark):
    assert one(spark, ex.tidy_place("n"), n="Some city") == "Some"
    assert one(spark, ex.area_label("p", "n", "k"), p=(None, "string"), n="Tract 1", k="Mixed") == "Tract 1 — Mixed"
    assert one(spark, ex.area_label("p", "n", "k"), p=(None, "string"), n=(None, "string"), k="Mixed") == "Unknown tract — Mixed"
    assert one(spark, ex.metric_kind("n"), n="s0101_E") == "estimate"
    assert one(spark, ex.metric_kind("n"), n="b19013_001e") == "derived"
    assert one(spark, ex.tag("n", {"a": "x"}, "other"), n="b") == "other"
    assert one(spark, ex.tag("n", {"a": "x"}), n="b") is None
