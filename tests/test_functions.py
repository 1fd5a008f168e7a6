"""Column functions, table by table."""

import math

import pytest
from pyspark.sql import functions as F

from tickwarden.functions import registers as g
from tickwarden.functions import rules as r
from tickwarden.functions import text as t


def values(spark, function, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [row["y"] for row in df.select("i", function(F.col("x")).alias("y")).orderBy("i").collect()]


def python_number(x):
    if x is None or x.strip().lower() in t.BLANKS:
        return None
    try:
        return float(x)
    except ValueError:
        return None


def test_number_is_pythons(spark):
    inputs = ["1", " 2.5\t", "1_000", "1__0", "245d", "0x1p3", ".5", "5.", "1e3", "+1", "-1e-2", "inf", "-Infinity", "nan", "", "n/a", "NULL", None, "abc", "1e", "--1"]
    got = values(spark, t.number, inputs)
    for x, y in zip(inputs, got):
        want = python_number(x)
        assert y == want or (want is not None and math.isnan(want) and math.isnan(y)), x


@pytest.mark.parametrize(
    "function, cases",
    [
        (t.boolean, {"true": True, " ON ": True, "0": False, "off": False, "maybe": None, None: None}),
        (t.flag, {"true": True, "no": False, "": False, None: False, "maybe": True}),
        (t.enabled, {"yes": True, "0": False, "on": None}),
        (t.has_value, {"x": True, " None ": False, "N/A": False, None: False, "\t\n": False}),
        (t.text, {"\t a b \n": "a b", None: ""}),
        (t.ingest_quality, {"good": "GOOD", "unknown": "UNCERTAIN", "odd": None}),
        (t.loader_quality, {"": "UNCERTAIN", "odd": "ODD"}),
        (t.severity, {"CRITICAL": "Critical", "info": "Info", "loud": None}),
        (t.stale_after, {"": 300, "junk": 300, "-5": 0, "12.9": 12, "inf": 300}),
        (t.delay_seconds, {"": 0, "junk": 0, "60.5": 60}),
        (t.non_negative_integer, {"": 0, "5": 5, "5.0": 5, "5.5": None, "-1": None, "true": None}),
        (t.semicolon_list, {"a; b;; c ": ["a", "b", "c"], "": [], None: []}),
        (t.replay_flag, {"on": True, "junk": False, None: False}),
        (lambda x: t.timestamp(x).cast("string"), {"2024-01-01 10:00": "2024-01-01 10:00:00", "2024-01-01T10:00:05": "2024-01-01 10:00:05", "2024-01-01T10:00:00+02:00": None, "2026": None, "soon": None}),
        (g.device_name, {" ups 1/a--b_": "UPS-1-A-B", "x": "X"}),
        (g.point_name, {"_load  kw%": "LOAD_KW", "a": "A"}),
        (g.title_words, {"PHASE3A LOAD": "Phase3A Load", "X1": "X1"}),
        (g.equipment_type, {"UPS-1": "UPS", "CRAC-2": "CRAC", "FOO": "Modbus Device"}),
        (g.data_type, {"Float32": "analog", "bit": "boolean", "text": None}),
    ],
)
def test_scalar(spark, function, cases):
    assert values(spark, function, list(cases)) == list(cases.values())


def evaluated(spark, **given):
    base = dict(rule_type="analog_limit", operator=">", threshold_value="240", clear_value="220", enabled=True, value="245", quality="GOOD", overridden=False, out_of_service=False, received="2024-01-01 12:00:00", at="2024-01-01 12:00:10", stale=30)
    b = base | given
    df = spark.createDataFrame([tuple(b.values())], "rule_type string, operator string, threshold_value string, clear_value string, enabled boolean, value string, quality string, overridden boolean, out_of_service boolean, received string, at string, stale long")
    df = df.select("*", F.col("received").cast("timestamp_ntz").alias("received_timestamp"), F.lit(None).cast("timestamp_ntz").alias("source_timestamp"), F.col("stale").alias("stale_after_seconds"), F.col("at").cast("timestamp_ntz").alias("evaluated_at"))
    row = r.evaluate(df).first()
    return row["status"], row["clears"]


@pytest.mark.parametrize(
    "given, status, clears",
    [
        ({}, "Triggered", False),
        ({"value": "240"}, "Normal", False),
        ({"value": "219"}, "Normal", True),
        ({"value": "220"}, "Normal", False),  # strict
        ({"operator": "<=", "threshold_value": "5", "clear_value": "10", "value": "11"}, "Normal", True),
        ({"operator": "<=", "threshold_value": "5", "clear_value": "10", "value": "10"}, "Normal", False),
        ({"enabled": False}, "Disabled", True),
        ({"value": None}, "No current value", False),  # an analog rule without a value holds
        ({"quality": "BAD"}, "BAD_QUALITY", False),
        ({"quality": "UNKNOWN"}, "UNCERTAIN_QUALITY", False),
        ({"quality": "odd"}, "UNCERTAIN_QUALITY", False),
        ({"quality": "STALE"}, "STALE", False),
        ({"overridden": True, "out_of_service": True, "quality": "BAD"}, "OVERRIDDEN", False),
        ({"out_of_service": True, "quality": "BAD"}, "OUT_OF_SERVICE", False),
        ({"stale": 9}, "STALE", False),
        ({"stale": 10}, "Triggered", False),  # strictly older
        ({"value": "junk"}, "Invalid analog value", False),
        ({"value": "nan"}, "Normal", False),
        ({"operator": "=="}, "Unsupported operator", True),
        ({"clear_value": "n/a", "value": "1"}, "Normal", True),
        ({"clear_value": "junk", "value": "230"}, "Normal", True),
        ({"rule_type": "boolean_state", "operator": "==", "threshold_value": "on", "value": "yes"}, "Triggered", False),
        ({"rule_type": "boolean_state", "operator": "==", "threshold_value": "on", "value": "perhaps"}, "Invalid boolean value", True),
        ({"rule_type": "enum_match", "operator": "!=", "threshold_value": "RUN ", "value": " run"}, "Normal", True),
        ({"rule_type": "other"}, "Unsupported rule type", True),
    ],
)
def test_evaluation(spark, given, status, clears):
    assert evaluated(spark, **given) == (status, clears)


def test_json_and_ids(spark):
    row = spark.range(1).select(t.json_object({"b": F.lit(1), "a": F.lit(None).cast("string")}).alias("j"), t.stable_id("PS", F.lit("P1"), F.lit(3)).alias("i")).first()
    assert row["j"] == '{"a":null,"b":1}'
    assert row["i"].startswith("PS-P1-") and len(row["i"]) == 18
