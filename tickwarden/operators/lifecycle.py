"""The alarm lifecycle over whole histories as window expressions.

Input is one row per evaluation: rule_id, ts, seq, status, clears, delay_seconds and what else is to be kept.
Within a rule, in order of (ts, seq) or another order, an alarm is PENDING from the first triggered evaluation, ACTIVE
once it stayed triggered for the rule's delay as it is at that evaluation (a longer delay later on does not undo that), and ends when an evaluation clears it; evaluations that neither trigger nor clear
hold an ACTIVE alarm and end a PENDING one.

Rules of up to ``segment_rows`` evaluations are worked on by one shuffle and one sort. Rules with more are cut into segments by
their number of rows: Spark range-partitions their rows in the order of the lifecycle, however many of them fall on one day or one second, and
writes them with the number of their partition to the shared folder, so that the cut stays the same whatever is lost later. What a segment does to the
state after it fits in one row: whether it ends triggered, since when, the latest start from which one of its leading triggered rows is
long enough after its own delay, and the last set or reset of the latch. Windows over those rows carry the state from segment to segment.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.rules import seconds_between
from ..sources.snapshots import shared_path
from .events import ACTOR, alarm_id, audit_events, details, time_text

NONE, PENDING, ACTIVE, CLEARED = "NONE", "PENDING", "ACTIVE", "CLEARED"
#: Evaluations of a rule that one task works through.
SEGMENT_ROWS = 1 << 20
ORDER = ("ts", "seq")
#: What an evaluation says of a rule that is not there.
VANISHED = "Rule not evaluated"


#: What an alarm keeps of the rule and of the sample that made it, and the columns that it comes from; nothing rewrites it.
SNAPSHOT_OF_RULE = ("rule_name", "rule_type", "operator", "threshold_value", "clear_value", "delay_seconds", "severity", "alarm_message")
SNAPSHOT_OF_SAMPLE = ("sample_id", "value", "quality", "source_timestamp", "received_timestamp")
SNAPSHOT = {f"{c}_at_trigger": c for c in SNAPSHOT_OF_RULE} | {f"triggering_{c}": c for c in SNAPSHOT_OF_SAMPLE}


def _elapsed(ts: Column, since: Column) -> Column:
    """Whether a triggered evaluation is long enough after the start of its run."""
    return (F.col("delay_seconds") <= 0) | (seconds_between(ts, since) >= F.col("delay_seconds"))


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def alarm_states(evaluations: DataFrame, segment_rows: int = SEGMENT_ROWS, order: tuple[str, ...] = ORDER) -> DataFrame:
    """The evaluations with previous_state, state, pending_since and episode (0 before the first).

    Counts the rules' evaluations first; only the rules with more than ``segment_rows`` are cut and their parts joined again.
    """
    long = evaluations.groupBy("rule_id").agg(F.count("*").alias("__n")).where(F.col("__n") > segment_rows)
    found = long.agg(F.sum("__n").alias("rows"), F.count("*").alias("rules")).first()
    if not found["rules"]:
        return _whole(evaluations, order)
    long = long.select(F.col("rule_id").alias("__long"))  # at most one rule for each segment_rows rows
    long = F.broadcast(long) if found["rules"] <= segment_rows else long
    same = F.col("rule_id").eqNullSafe(F.col("__long"))
    cut = evaluations.join(long, same, "left_semi").repartitionByRange(math.ceil(found["rows"] / segment_rows), "rule_id", *order).withColumn("__segment", F.spark_partition_id())
    cut.write.parquet(path := shared_path(evaluations.sparkSession, "segments"))
    cut = evaluations.sparkSession.read.schema(cut.schema).parquet(path)
    return _whole(evaluations.join(long, same, "left_anti"), order).unionByName(_segmented(cut, order).drop("__segment"))


def _whole(evaluations: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """States of rules whose rows one task sees: one exchange and one sort under all windows."""
    of = Window.partitionBy("rule_id").orderBy(*order)
    so_far = of.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    trig = F.col("__trig")
    stated = (
        evaluations.withColumn("__trig", F.coalesce(F.col("status") == "Triggered", F.lit(False)))
        .withColumn("__since", F.last(F.when(trig & ~F.lag("__trig", 1, False).over(of), F.col("ts")), ignorenulls=True).over(so_far))
        .withColumn("__latch", F.when(trig & _elapsed(F.col("ts"), F.col("__since")), 1).when(~trig & F.col("clears"), 0))
        .withColumn("__latched", F.coalesce(F.last("__latch", ignorenulls=True).over(so_far), F.lit(0)))
        .withColumn("state", F.when(F.col("__latched") == 1, ACTIVE).when(trig, PENDING).otherwise(NONE))
        .withColumn("previous_state", F.lag("state", 1, NONE).over(of))
    )
    opens = ((F.col("previous_state") == NONE) & (F.col("state") != NONE)).cast("long")
    return stated.select(*evaluations.columns, "previous_state", "state", F.when(trig, F.col("__since")).alias("pending_since"), F.sum(opens).over(so_far).alias("episode"))


def _segmented(evaluations: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """States of rules whose rows lie in segments (__segment), which follow each other in the order."""
    rows_of = Window.partitionBy("rule_id", "__segment").orderBy(*order)
    so_far = rows_of.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    trig, lead = F.col("__trig"), F.col("__lead")
    rows = (
        evaluations.withColumn("__trig", F.coalesce(F.col("status") == "Triggered", F.lit(False)))
        .withColumn("__lead", F.bool_and("__trig").over(so_far))
        .withColumn("__edge", F.when(trig & ~lead & ~F.lag("__trig").over(rows_of), F.col("ts")))
        .withColumn("__since", F.last("__edge", ignorenulls=True).over(so_far))
        .withColumn("__latch", F.when(trig & ~lead & _elapsed(F.col("ts"), F.col("__since")), 1).when(~trig & F.col("clears"), 0))
        .withColumn("__latched", F.last("__latch", ignorenulls=True).over(so_far))
        # with no delay any start is early enough
        .withColumn("__ready", F.max(F.when(lead, F.when(F.col("delay_seconds") <= 0, F.lit(2**63 - 1)).otherwise(_micros(F.col("ts")) - F.col("delay_seconds") * 1_000_000))).over(so_far))
    )
    at = F.struct(*order)
    segments = rows.groupBy("rule_id", "__segment").agg(
        F.max_by("__trig", at).alias("ends_triggered"),
        F.min_by("ts", F.when(lead, at)).alias("lead_first"),
        F.max("__ready").alias("lead_ready"),
        F.max_by("__edge", F.when(F.col("__edge").isNotNull(), at)).alias("last_edge"),
        F.max_by("__latch", F.when(F.col("__latch").isNotNull(), at)).alias("last_latch"),
    )
    segments_of = Window.partitionBy("rule_id").orderBy("__segment")
    before = segments_of.rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        segments.withColumn("was_triggered", F.coalesce(F.lag("ends_triggered").over(segments_of), F.lit(False)))
        .withColumn("lead_start", F.when(~F.col("was_triggered"), F.col("lead_first")))
        .withColumn("since_before", F.last(F.coalesce("last_edge", "lead_start"), ignorenulls=True).over(before))
        .withColumn("lead_since", F.when(F.col("lead_first").isNotNull(), F.coalesce("lead_start", "since_before")))
        .withColumn("lead_sets", F.col("lead_ready") >= _micros(F.col("lead_since")))
        .withColumn("latch_after", F.coalesce("last_latch", F.when(F.col("lead_sets"), 1)))
        .withColumn("latch_before", F.coalesce(F.last("latch_after", ignorenulls=True).over(before), F.lit(0)))
        .withColumn("state_before", F.when(F.col("latch_before") == 1, ACTIVE).when(F.col("was_triggered"), PENDING).otherwise(NONE))
        .select("rule_id", "__segment", *(F.col(c).alias(f"__{c}") for c in ("lead_since", "lead_sets", "latch_before", "state_before")))
    )
    in_lead = F.when(F.col("__ready") >= _micros(F.col("__lead_since")), 1).otherwise(F.col("__latch_before"))
    after_lead = F.coalesce("__latched", F.when(F.col("__lead_sets"), 1), "__latch_before")
    stated = (
        rows.join(carried, ["rule_id", "__segment"])
        .withColumn("state", F.when(F.when(lead, in_lead).otherwise(after_lead) == 1, ACTIVE).when(trig, PENDING).otherwise(NONE))
        .withColumn("previous_state", F.coalesce(F.lag("state").over(rows_of), F.col("__state_before")))
        .withColumn("pending_since", F.when(trig, F.when(lead, F.col("__lead_since")).otherwise(F.col("__since"))))
        .withColumn("__opens", ((F.col("previous_state") == NONE) & (F.col("state") != NONE)).cast("long"))
        .withColumn("__opened", F.sum("__opens").over(so_far))
    )
    counts = stated.groupBy("rule_id", "__segment").agg(F.sum("__opens").alias("n"))
    counts = counts.select("rule_id", "__segment", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__opened_before"))
    keep = [F.col(c) for c in evaluations.columns]
    return stated.join(counts, ["rule_id", "__segment"]).select(*keep, "previous_state", "state", "pending_since", (F.col("__opened") + F.col("__opened_before")).alias("episode"))


def continued(evaluations: DataFrame, before: DataFrame | None, segment_rows: int = SEGMENT_ROWS, order: tuple[str, ...] = ORDER) -> DataFrame:
    """States of evaluations that follow on others, which ended in ``before`` (rule_id, state, since, episode); null: nothing came before.

    An open alarm goes in as rows of its own ahead of its rule's: one that triggers since then, at once or never long enough, and for an alarm that is only held another one that doesn't trigger.
    """
    if before is None:
        return alarm_states(evaluations, segment_rows, order)
    first, never = F.lit("0001-01-01").cast("timestamp_ntz"), F.lit(2**40).cast("bigint")
    kept = before.where(F.col("state").isin(PENDING, ACTIVE)).join(evaluations.select("rule_id").distinct(), "rule_id", "left_semi")
    row = lambda ts, place, status, delay: F.struct(ts.alias("ts"), F.lit(place).alias("__carry"), F.lit(status).alias("status"), F.lit(False).alias("clears"), delay.cast("bigint").alias("delay_seconds"))
    opened = row(F.coalesce("since", first), 0, "Triggered", F.when(F.col("state") == ACTIVE, 0).otherwise(never))
    held = F.when(F.col("since").isNull(), row(first, 1, "Held", F.lit(0)))
    carry = kept.select("rule_id", F.explode(F.filter(F.array(opened, held), lambda x: x.isNotNull())).alias("r")).select("rule_id", "r.*")
    blank = {c: F.lit(None).cast(evaluations.schema[c].dataType) for c in evaluations.columns if c not in carry.columns}
    rows = evaluations.withColumn("__carry", F.lit(2)).unionByName(carry.withColumns(blank).select(*evaluations.columns, "__carry"))
    states = alarm_states(rows, segment_rows, ("__carry", *order)).where("__carry = 2").drop("__carry")
    past = before.select("rule_id", F.when(F.col("state").isin(PENDING, ACTIVE), F.col("episode") - 1).otherwise(F.col("episode")).alias("__past"))
    out = states.join(past, "rule_id", "left").withColumn("episode", F.col("episode") + F.coalesce("__past", F.lit(0)))
    return out.drop("__past").select(*states.columns)


def end_states(states: DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    """rule_id, state, since (of the run of triggered evaluations that it ends in) and episode of each rule after its last evaluation."""
    last = F.max_by(F.struct("state", F.col("pending_since").alias("since"), "episode"), F.struct(*order))
    return states.groupBy("rule_id").agg(last.alias("l")).select("rule_id", "l.*")


def transitions(states: DataFrame) -> DataFrame:
    """Rows where the state changes, with the audit event's type and states."""
    left, entered = F.col("previous_state"), F.col("state")
    event = F.when(entered == PENDING, "PENDING_CREATED").when(entered == ACTIVE, "ALARM_ACTIVATED").otherwise("ALARM_CLEARED")
    return states.where(left != entered).select(
        "*", event.alias("event_type"), F.when(left == NONE, "").otherwise(left).alias("event_previous_state"), F.when(entered == NONE, CLEARED).otherwise(entered).alias("event_new_state")
    )


def episodes(states: DataFrame, snapshot: dict[str, Column | str] | None = None) -> DataFrame:
    """One row per alarm: its times, its state at the end, and ``snapshot`` as it was when the alarm was created."""
    order = F.struct("ts", "seq")
    of = states.where((F.col("state") != NONE) | (F.col("previous_state") != NONE))
    ended = F.max(F.when(F.col("state") == NONE, F.col("ts")))
    taken = [F.min_by(c, order).alias(name) for name, c in (snapshot or {}).items()]
    return of.groupBy("rule_id", "episode").agg(
        F.min("ts").alias("created_at"),
        F.min(F.when(F.col("state") == PENDING, F.col("ts"))).alias("pending_started_at"),
        F.min(F.when(F.col("state") == ACTIVE, F.col("ts"))).alias("triggered_at"),
        ended.alias("cleared_at"),
        F.max("ts").alias("last_evaluated_at"),
        F.when(ended.isNotNull(), CLEARED).otherwise(F.max_by("state", order)).alias("state"),
        F.count("*").alias("evaluations"),
        *taken,
    )


def with_vanished(evaluations: DataFrame) -> DataFrame:
    """Evaluations in which a rule that is not there (``present`` false) says so and clears what it left open."""
    gone = ~F.col("present")
    return evaluations.withColumns({"status": F.when(gone, VANISHED).otherwise(F.col("status")), "clears": gone | F.col("clears")})


def orphaned(alarms: DataFrame, rules: DataFrame) -> DataFrame:
    """Open alarms whose rule is gone: cleared, with a note."""
    gone = alarms.where(F.col("state").isin(PENDING, ACTIVE)).join(rules.select("rule_id"), "rule_id", "left_anti")
    return gone.withColumn("state", F.lit(CLEARED)).withColumn("evaluation_note", F.lit(VANISHED))


def _commands(commands: DataFrame) -> DataFrame:
    """Commands with ``by``: their operator, or the local one where none is named."""
    return commands.withColumn("by", F.when(t.has_value(F.col("operator")), t.text(F.col("operator"))).otherwise(ACTOR))


def acknowledge(alarms: DataFrame, commands: DataFrame) -> DataFrame:
    """Alarms with acknowledged, acknowledged_at and acknowledged_by; of several commands on (rule_id, episode) the last one stays."""
    last = _commands(commands).groupBy("rule_id", "episode").agg(F.max(F.struct(F.col("acknowledged_at").alias("at"), "by")).alias("ack"))
    out = alarms.join(last, ["rule_id", "episode"], "left")
    return out.select(*alarms.columns, F.col("ack").isNotNull().alias("acknowledged"), F.col("ack.at").alias("acknowledged_at"), F.coalesce("ack.by", F.lit("")).alias("acknowledged_by"))


def first_open(alarms: DataFrame) -> DataFrame:
    """The open alarm of each rule that an evaluation goes on with: an ACTIVE one before PENDING ones, then the one evaluated last."""
    rank = F.struct((F.col("state") == ACTIVE).alias("active"), "last_evaluated_at", "episode")
    return alarms.where(F.col("state").isin(PENDING, ACTIVE)).groupBy("rule_id").agg(F.max_by(F.struct("episode", "state"), rank).alias("a")).select("rule_id", "a.*")


def acknowledge_events(alarms: DataFrame, commands: DataFrame, current: DataFrame) -> DataFrame:
    """ALARM_ACKNOWLEDGED for each command on an alarm that is there; its state stays as it is.

    ``alarms`` has rule_id, episode, point_id, equipment_id, state, triggered_value and alarm_message, ``current`` the latest sample_id of each point.
    """
    df = _commands(commands).join(alarms, ["rule_id", "episode"]).join(current.select("point_id", "sample_id"), "point_id", "left")
    return audit_events(
        df,
        {
            "generated_alarm_id": alarm_id(F.col("rule_id"), F.col("episode")),
            **{c: F.col(c) for c in ("rule_id", "point_id", "equipment_id", "sample_id")},
            "event_type": "ALARM_ACKNOWLEDGED",
            "event_timestamp": F.col("acknowledged_at"),
            "value": F.col("triggered_value"),
            "previous_state": F.col("state"),
            "new_state": F.col("state"),
            "acknowledged_by": F.col("by"),
            "message": F.col("alarm_message"),
            "details_json": details({"acknowledged_by": F.col("by")}),
        },
    )


def lifecycle_events(changes: DataFrame) -> DataFrame:
    """The audit events of ``transitions``, with the facts of the evaluation that made each; rows have the rule, its point's equipment, the sample and its times."""
    facts = {c: F.col(c) for c in ("operator", "rule_type", "threshold_value", "clear_value", "delay_seconds", "severity", "alarm_message")}
    facts |= {"evaluation_status": F.col("status"), "triggering_sample_id": t.text(F.col("sample_id")), "triggering_value": t.text(F.col("value")), "triggering_quality": t.text(F.col("quality"))}
    facts |= {f"triggering_{c}": F.coalesce(time_text(F.col(c)), F.lit("")) for c in ("source_timestamp", "received_timestamp")}
    return audit_events(
        changes,
        {
            "generated_alarm_id": alarm_id(F.col("rule_id"), F.col("episode")),
            **{c: F.col(c) for c in ("rule_id", "point_id", "equipment_id", "event_type", "value", "sample_id")},
            "event_timestamp": F.col("ts"),
            "previous_state": F.col("event_previous_state"),
            "new_state": F.col("event_new_state"),
            "message": F.when(F.col("event_type") == "PENDING_CREATED", "Pending delay").otherwise(F.col("status")),
            "details_json": details(facts),
        },
    )
