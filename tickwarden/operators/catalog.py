"""Creating and updating rules: checks, differences and audit events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from .events import ACTOR, audit_events, details

#: The fields that an update may change, those that a new rule must have, in the order of messages, and those that its event tells.
EDITABLE = ("threshold_value", "clear_value", "delay_seconds", "severity", "alarm_message", "enabled")
NEEDED = ("id", "point_id", "rule_name", "rule_type", "operator", "severity", "alarm_message", "enabled")
CREATED_DETAILS = ("id", "point_id", "rule_name", "rule_type", "operator", "threshold_value", "clear_value", "delay_seconds", "severity", "alarm_message", "enabled")
TYPED = {"delay_seconds": "bigint", "enabled": "boolean"}

_named = {"id": "rule_id"}


def _field(name: str) -> Column:
    return F.col(_named.get(name, name))


def _one_of(field: str, values: tuple[str, ...]) -> str:
    return f"{field} must be one of: {', '.join(sorted(values))}"


def _whole_seconds(c: Column) -> Column:
    """Null where the text is no whole number from 0 on; blank is 0."""
    return t.non_negative_integer(c)


def checked_rules(requests: DataFrame, rules: DataFrame, points: DataFrame, extra: str | None = None) -> DataFrame:
    """Requests to create rules with ``error``, the first thing that is wrong with each, or null.

    In this order: fields that no rule knows (``extra`` names a column with their names), fields that are missing or blank, all in one
    message, then type, operator, severity, enabled and delay, then an id that is taken, last a point that is not there. Thresholds may be blank.
    """
    unknown = F.coalesce(F.array_join(F.array_sort(extra), ", "), F.lit("")) if extra else F.lit("")
    rule_id, point_id = t.text(F.col("rule_id")), t.text(F.col("point_id"))
    df = requests.join(rules.select(F.col("rule_id").alias("__taken")), rule_id == F.col("__taken"), "left").join(points.select(F.col("point_id").alias("__known")), point_id == F.col("__known"), "left")
    missing = F.array_join(F.filter(F.array(*(F.when(~t.has_value(_field(f)), F.lit(f)) for f in NEEDED)), lambda x: x.isNotNull()), ", ")
    kind = F.lower(t.text(F.col("rule_type")))
    allowed = t.operators_for(kind)
    error = F.coalesce(
        F.when(unknown != "", F.concat(F.lit("Unsupported alarm rule field(s): "), unknown)),
        F.when(missing != "", F.concat(F.lit("Missing required alarm rule field(s): "), missing)),
        F.when(allowed.isNull(), F.lit(_one_of("rule_type", t.RULE_TYPES))),
        F.when(~F.array_contains(allowed, t.text(F.col("operator"))), F.concat(F.lit("operator for "), kind, F.lit(" must be one of: "), F.array_join(F.array_sort(allowed), ", "))),
        F.when(t.severity(F.col("severity")).isNull(), F.lit(_one_of("severity", t.SEVERITIES))),
        F.when(t.enabled(F.col("enabled")).isNull(), F.lit("enabled must be one of: 1, 0, true, false, yes, no")),
        F.when(_whole_seconds(F.col("delay_seconds")).isNull(), F.lit("delay_seconds must be a non-negative integer")),
        F.when(F.col("__taken").isNotNull(), F.concat(F.lit("Alarm rule already exists: "), rule_id)),
        F.when(F.col("__known").isNull(), F.concat(F.lit("Point not found: "), point_id)),
    )
    return df.select(*requests.columns, error.alias("error"))


def normalised_rules(requests: DataFrame) -> DataFrame:
    """Requests without an error as the catalog keeps them."""
    put = {
        **{c: t.text(F.col(c)) for c in ("rule_id", "point_id", "rule_name", "operator", "alarm_message")},
        **{c: t.optional_text(F.col(c)) for c in ("threshold_value", "clear_value")},
        "rule_type": F.lower(t.text(F.col("rule_type"))),
        "severity": t.severity(F.col("severity")),
        "enabled": t.enabled(F.col("enabled")),
        "delay_seconds": _whole_seconds(F.col("delay_seconds")).cast("bigint"),
    }
    return requests.select(*(c.alias(n) for n, c in put.items()))


def audit_records(rules: DataFrame, points: DataFrame) -> DataFrame:
    """Rows with the equipment of their points, empty where the point is not known."""
    out = rules.join(points.select("point_id", "equipment_id"), "point_id", "left")
    return out.withColumn("equipment_id", F.coalesce("equipment_id", F.lit("")))


def created_events(created: DataFrame, points: DataFrame, at: Column) -> DataFrame:
    """RULE_CREATED for each new rule, the whole rule as JSON in its details."""
    rule = F.struct(*(_field(f).alias(f) for f in sorted(CREATED_DETAILS)))
    return audit_events(
        audit_records(created, points),
        {
            "rule_id": F.col("rule_id"),
            "point_id": F.col("point_id"),
            "equipment_id": F.col("equipment_id"),
            "event_type": "RULE_CREATED",
            "event_timestamp": at,
            "acknowledged_by": ACTOR,
            "message": F.concat(F.lit("Alarm rule created: "), "rule_name"),
            "details_json": details({"created_rule": rule}),
        },
    )


def checked_updates(updates: DataFrame, rules: DataFrame, extra: str | None = None) -> DataFrame:
    """Updates with ``error``, the first thing that is wrong with each, or null; a null field is not part of an update."""
    unknown = F.coalesce(F.array_join(F.array_sort(extra), ", "), F.lit("")) if extra else F.lit("")
    df = updates.join(rules.select(F.col("rule_id").alias("__known")), F.col("rule_id") == F.col("__known"), "left")
    given = lambda f, bad, said: F.when(F.col(f).isNotNull() & bad, F.lit(said))
    error = F.coalesce(
        F.when(unknown != "", F.concat(F.lit("Unsupported alarm rule field(s): "), unknown)),
        given("delay_seconds", _whole_seconds(F.col("delay_seconds")).isNull(), "delay_seconds must be a non-negative integer"),
        given("severity", t.severity(F.col("severity")).isNull(), _one_of("severity", t.SEVERITIES)),
        given("enabled", t.enabled(F.col("enabled")).isNull(), "enabled must be one of: 1, 0, true, false, yes, no"),
        F.when(F.col("__known").isNull(), F.concat(F.lit("Alarm rule not found: "), "rule_id")),
    )
    return df.select(*updates.columns, error.alias("error"))


def _new_value(field: str) -> Column:
    c = F.col(field)
    put = {"severity": t.severity(c), "enabled": t.enabled(c), "delay_seconds": _whole_seconds(c), "alarm_message": t.text(c)}.get(field, t.optional_text(c))
    return F.when(c.isNotNull(), put.cast(TYPED.get(field, "string")))


def _paired(rules: DataFrame, updates: DataFrame) -> DataFrame:
    """Rules with new_<field> of their update, normalised; null where the update leaves the field."""
    return rules.join(updates.select("rule_id", *(_new_value(f).alias(f"new_{f}") for f in EDITABLE)), "rule_id")


def _changed(field: str) -> Column:
    return F.col(f"new_{field}").isNotNull() & ~F.col(field).cast(TYPED.get(field, "string")).eqNullSafe(F.col(f"new_{field}"))


def rule_changes(rules: DataFrame, updates: DataFrame) -> DataFrame:
    """One row for each rule and editable field that an update changes: old_value and new_value as text; null updates keep the field."""
    fields = F.array(*(F.when(_changed(f), F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("old_value"), F.col(f"new_{f}").cast("string").alias("new_value"))) for f in EDITABLE))
    return _paired(rules, updates).select("rule_id", F.explode(F.filter(fields, lambda x: x.isNotNull())).alias("c")).select("rule_id", "c.field", "c.old_value", "c.new_value")


def updated_rules(rules: DataFrame, updates: DataFrame) -> DataFrame:
    """The rules after the updates."""
    out = rules.join(updates.select("rule_id", *(_new_value(f).alias(f"new_{f}") for f in EDITABLE)), "rule_id", "left")
    return out.select(*(F.coalesce(F.col(f"new_{c}").cast(rules.schema[c].dataType), F.col(c)).alias(c) if c in EDITABLE else F.col(c) for c in rules.columns))


def update_events(rules: DataFrame, updates: DataFrame, points: DataFrame, at: Column) -> DataFrame:
    """RULE_UPDATED with the changed fields in their order and the old and new values, typed, as JSON; an update that changes nothing makes no event."""
    names = F.filter(F.array(*(F.when(_changed(f), F.lit(f)) for f in EDITABLE)), lambda x: x.isNotNull())
    # a struct with a null for what did not change is written without it
    side = lambda prefix: F.to_json(F.struct(*(F.when(_changed(f), F.col(f"{prefix}{f}").cast(TYPED.get(f, "string"))).alias(f) for f in sorted(EDITABLE))))
    json = F.concat(F.lit('{"changed_fields":'), F.to_json(names), F.lit(',"new_values":'), side("new_"), F.lit(',"old_values":'), side(""), F.lit("}"))
    df = _paired(rules, updates).withColumn("names", names).where(F.size("names") > 0).withColumn("json", json)
    return audit_events(
        audit_records(df, points),
        {
            "rule_id": F.col("rule_id"),
            "point_id": F.col("point_id"),
            "equipment_id": F.col("equipment_id"),
            "event_type": "RULE_UPDATED",
            "event_timestamp": at,
            "acknowledged_by": ACTOR,
            "message": F.concat(F.lit("Alarm rule updated: "), "rule_name"),
            "details_json": F.col("json"),
        },
    )
