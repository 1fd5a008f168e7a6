"""Sample health, rule evaluation and clearing as ordered CASE expressions."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as t

INELIGIBLE = ("BAD_QUALITY", "UNCERTAIN_QUALITY", "STALE", "OVERRIDDEN", "OUT_OF_SERVICE")


def seconds_between(later: Column, earlier: Column) -> Column:
    """Seconds as a double, with microseconds."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(1e6)


def quality_status(quality: Column) -> Column:
    q = F.upper(t.text(quality))
    return F.when(q == "BAD", "BAD_QUALITY").when(q == "STALE", "STALE").otherwise("UNCERTAIN_QUALITY")


def is_stale(received: Column, source: Column, stale_after: Column, at: Column) -> Column:
    """Older than its window, strictly; never without both times."""
    return F.coalesce(seconds_between(at, F.coalesce(received, source)) > stale_after, F.lit(False))


def eligibility(quality: Column, overridden: Column, out_of_service: Column, stale: Column) -> Column:
    return (
        F.when(F.coalesce(overridden, F.lit(False)), "OVERRIDDEN")
        .when(F.coalesce(out_of_service, F.lit(False)), "OUT_OF_SERVICE")
        .when(F.upper(t.text(quality)) != "GOOD", quality_status(quality))
        .when(stale, "STALE")
        .otherwise("ELIGIBLE")
    )


def compare(operator: Column, a: Column, b: Column) -> Column:
    return (
        F.when(operator == "==", a == b)
        .when(operator == "!=", a != b)
        .when(operator == ">", a > b)
        .when(operator == ">=", a >= b)
        .when(operator == "<", a < b)
        .when(operator == "<=", a <= b)
        .otherwise(False)
    )


@dataclass(frozen=True)
class Parsed:
    """What the fields of an evaluation say, each parsed once."""

    number: Column
    threshold: Column
    clear: Column
    state: Column
    threshold_state: Column
    word: Column
    threshold_word: Column
    present: Column
    clears_by_value: Column
    good: Column

    @staticmethod
    def of(value: Column, threshold: Column, clear_value: Column, quality: Column) -> Parsed:
        return Parsed(
            t.number(value),
            t.number(threshold),
            t.number(clear_value),
            t.boolean(value),
            t.boolean(threshold),
            F.lower(t.text(value)),
            F.lower(t.text(threshold)),
            t.has_value(value),
            t.has_value(clear_value),
            F.upper(t.text(quality)) == "GOOD",
        )


def evaluation_status(rule_type: Column, operator: Column, enabled: Column, eligible: Column, v: Parsed) -> Column:
    """The status of a rule against a value; the rule is triggered where it is ``Triggered``."""
    comparable = ~F.isnan(v.number) & ~F.isnan(v.threshold)
    said = lambda hit: F.when(hit, "Triggered").otherwise("Normal")
    wrong = lambda allowed: F.when(~operator.isin(*allowed), "Unsupported operator")
    analog = wrong(t.ANALOG_OPERATORS).when(v.number.isNull() | v.threshold.isNull(), "Invalid analog value").otherwise(said(comparable & compare(operator, v.number, v.threshold)))
    state = wrong(t.MATCH_OPERATORS).when(v.state.isNull() | v.threshold_state.isNull(), "Invalid boolean value").otherwise(said(compare(operator, v.state, v.threshold_state)))
    enum = wrong(t.MATCH_OPERATORS).otherwise(said(compare(operator, v.word, v.threshold_word)))
    return (
        F.when(~F.coalesce(enabled, F.lit(False)), "Disabled")
        .when(~v.present, "No current value")
        .when(eligible != "ELIGIBLE", eligible)
        .when(rule_type == "analog_limit", analog)
        .when(rule_type == "boolean_state", state)
        .when(rule_type == "enum_match", enum)
        .otherwise("Unsupported rule type")
    )


def should_clear(status: Column, rule_type: Column, operator: Column, v: Parsed) -> Column:
    """Whether an active alarm clears on this evaluation; clear values are passed strictly."""
    passed = F.when(operator.isin(">", ">="), v.number < v.clear).otherwise(v.number > v.clear) & ~F.isnan(v.number) & ~F.isnan(v.clear)
    return (
        F.when(status == "Disabled", True)
        .when(status == "Triggered", False)
        .when(status.isin(*INELIGIBLE), False)
        .when(rule_type != "analog_limit", True)
        .when(~v.clears_by_value, True)
        .when(~operator.isin(*t.ANALOG_OPERATORS), True)
        .when(~v.good, False)
        .when(v.clear.isNull(), True)
        .when(v.number.isNull(), False)
        .otherwise(passed)
    )


def evaluate(df: DataFrame) -> DataFrame:
    """Rows of rule, value and evaluated_at with status and clears.

    Reads rule_type, operator, threshold_value, clear_value, enabled, value, quality, overridden,
    out_of_service, received_timestamp, source_timestamp and stale_after_seconds.
    """
    c = F.col
    parsed = Parsed.of(c("value"), c("threshold_value"), c("clear_value"), c("quality"))
    names = {f.name: f"__{f.name}" for f in fields(Parsed)}
    wide = df.withColumns({names[k]: getattr(parsed, k) for k in names})  # columns of their own, so that no branch parses again
    v = Parsed(**{k: c(n) for k, n in names.items()})
    stale = is_stale(c("received_timestamp"), c("source_timestamp"), c("stale_after_seconds"), c("evaluated_at"))
    eligible = eligibility(c("quality"), c("overridden"), c("out_of_service"), stale)
    wide = wide.withColumn("status", evaluation_status(c("rule_type"), c("operator"), c("enabled"), eligible, v))
    return wide.withColumn("clears", should_clear(c("status"), c("rule_type"), c("operator"), v)).drop(*names.values())


def note_while_active(status: Column, rule_type: Column, clear_value: Column) -> Column:
    return F.when((rule_type == "analog_limit") & t.has_value(clear_value) & (status == "Normal"), "Waiting for clear value").otherwise(status)
