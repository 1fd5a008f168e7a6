"""Audit events: one layout for all kinds, ids that follow from what happened, details as compact JSON with sorted keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t

#: The columns of an event, and the actor where none is named.
FIELDS = ("generated_alarm_id", "rule_id", "point_id", "equipment_id", "event_type", "event_timestamp", "value", "sample_id", "previous_state", "new_state", "acknowledged_by", "message", "details_json")
NULLABLE = ("generated_alarm_id", "rule_id")
ACTOR = "local-operator"


def time_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def _hex(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256), 1, 12)


def sample_id(point_id: Column, ingest_seq: Column) -> Column:
    return F.concat(F.lit("PS-"), point_id, F.lit("-"), _hex(point_id, ingest_seq))


def alarm_id(rule_id: Column, episode: Column) -> Column:
    return F.concat(F.lit("GA-"), rule_id, F.lit("-"), _hex(rule_id, episode))


def details(values: dict[str, Column]) -> Column:
    """Compact JSON; keys are sorted, null stays null."""
    return F.to_json(F.struct(*(values[k].alias(k) for k in sorted(values))), {"ignoreNullFields": "false"})


def audit_events(rows: DataFrame, columns: dict[str, Column | str]) -> DataFrame:
    """``id`` and FIELDS for each row. Texts are stripped, what is not given is empty; alarm and rule may be null."""
    given = {k: F.lit(v) if isinstance(v, str) else v for k, v in columns.items()}

    def cell(name: str) -> Column:
        if name == "event_timestamp":
            return given[name]
        if name in NULLABLE:
            return given.get(name, F.lit(None)).cast("string")
        return F.coalesce(given.get(name, F.lit("")), F.lit("")) if name == "details_json" else t.text(given.get(name, F.lit("")))

    out = rows.select(*(cell(n).alias(n) for n in FIELDS))
    key = _hex(*(F.col(n) for n in ("generated_alarm_id", "rule_id", "point_id", "event_type")), time_text(F.col("event_timestamp")), *(F.col(n) for n in ("sample_id", "previous_state", "new_state", "details_json")))
    return out.select(F.concat(F.lit("AE-"), key).alias("id"), *FIELDS)
