"""Latest values, values as of a grid of ticks, and changes from sample to sample.

Arrival order (``ingest_seq``) decides what is latest, whatever the samples' own times say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from .events import ACTOR, audit_events

#: Arrivals of all points that make a chunk of each point's history.
CHUNK_ROWS = 1 << 17


def latest(samples: DataFrame, key: str = "point_id") -> DataFrame:
    """The sample of each point that arrived last; samples are reduced before the shuffle."""
    last = F.max_by(F.struct(*samples.columns), F.col("ingest_seq"))
    return samples.groupBy(F.col(key).alias("__key")).agg(last.alias("s")).select("s.*")


def as_of_ticks(samples: DataFrame, points: DataFrame, first: Column, last: Column, step_seconds: int, key: str = "point_id") -> DataFrame:
    """For each point and tick, ``sample``: the last arrived of the samples taken up to the tick, or null.

    Samples are reduced to one for each point and step before the shuffle, so that a point costs its
    ticks. ``first`` and ``last`` are literals or columns of ``points``.
    """
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    width = F.lit(step_seconds * 1_000_000)
    grid = points.select(key, first.alias("first"), last.alias("last")).withColumn("tick", F.explode(F.sequence("first", "last", F.make_dt_interval(secs=F.lit(step_seconds)))))
    starts = points.select(key, first.alias("first"))
    steps = samples.join(starts, key).withColumn("k", F.greatest(F.ceil((micros(F.col("ts")) - micros(F.col("first"))) / width), F.lit(0)))
    reduced = steps.groupBy(key, "k").agg(F.max_by(F.struct(*samples.columns), F.col("ingest_seq")).alias("s"))
    at = grid.withColumn("k", ((micros(F.col("tick")) - micros(F.col("first"))) / width).cast("long"))
    up_to = Window.partitionBy(key).orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = at.join(reduced, [key, "k"], "left")
    ordered = F.struct(F.col("s.ingest_seq").alias("seq"), F.col("s").alias("s"))
    return joined.withColumn("seen", F.max(F.when(F.col("s").isNotNull(), ordered)).over(up_to)).select(key, "tick", F.col("seen.s").alias("sample"))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, since: str, name: str) -> DataFrame:
    """The left rows with ``name``: of the right rows of their key the one with the greatest ``since`` up to the row's ``at``, or null.

    One union of both sides and one window, whatever the distances between the times. What a key costs is its rows of both sides.
    """
    sides = left.select(F.col(key).alias("__key"), F.col(at).alias("__at"), F.lit(1).alias("__side"), F.struct("*").alias("__left"), F.lit(None).cast(right.schema).alias("__right"))
    other = right.select(F.col(key).alias("__key"), F.col(since).alias("__at"), F.lit(0).alias("__side"), F.lit(None).cast(left.schema).alias("__left"), F.struct("*").alias("__right"))
    up_to = Window.partitionBy("__key").orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = sides.unionByName(other).withColumn("__seen", F.last("__right", ignorenulls=True).over(up_to)).where("__side = 1")
    return seen.select("__left.*", F.col("__seen").alias(name))


def replay_steps(samples: DataFrame) -> DataFrame:
    """sequence, step (their places in the order of the replay, from 1) and ``at``, the greatest source time of the step's samples; a step none of whose samples has a time has none.

    Steps are the distinct sequences of the samples: numbers first, in their order, then texts.
    """
    number = F.col("sequence").try_cast("bigint")
    steps = samples.where(t.text(F.col("sequence")) != "").groupBy("sequence").agg(F.max("source_timestamp").alias("at"))
    return steps.withColumn("step", F.row_number().over(Window.orderBy(number.isNull(), number, "sequence")).cast("bigint")).select("sequence", "step", "at")  # a row for each step


def values_at_steps(samples: DataFrame, steps: DataFrame, points: DataFrame) -> DataFrame:
    """point_id, step, at and ``sample``: for each point and step the sample that arrived last, in this step or an earlier one; null before the first.

    What arrives later wins, whatever the samples' own times say: steps arrive in their order, samples within a step by
    ``ingest_seq``. Samples are reduced to one for each point and step before they are shuffled.
    """
    placed = samples.join(F.broadcast(steps.select("sequence", "step")), "sequence")  # steps are what the replay loops over
    last = placed.groupBy("point_id", "step").agg(F.max_by(F.struct(*samples.columns), "ingest_seq").alias("s"))
    grid = points.select("point_id").crossJoin(F.broadcast(steps.where("at is not null").select("step", "at")))  # every rule is evaluated at every step
    out = as_of(grid, last.select("point_id", F.col("step").alias("since"), "s"), "point_id", "step", "since", "seen")
    return out.select("point_id", "step", "at", F.col("seen.s").alias("sample"))


def rules_at(versions: DataFrame, steps: DataFrame) -> DataFrame:
    """A row for each rule and step from its first version on, with the version in force at the step's time and ``present``: whether there is one.

    ``versions`` has valid_from and valid_to (null: still in force; at valid_to itself a version is over) for each version of a rule_id.
    """
    first = versions.groupBy("rule_id").agg(F.min("valid_from").alias("first"))
    grid = first.join(F.broadcast(steps.where("at is not null").select("step", "at")), F.col("at") >= F.col("first")).select("rule_id", "step", "at")
    out = as_of(grid, versions, "rule_id", "at", "valid_from", "v")
    present = F.col("v.valid_to").isNull() | (F.col("at") < F.col("v.valid_to"))
    kept = [c for c in versions.columns if c not in ("rule_id", "valid_from", "valid_to")]
    return out.select("rule_id", "step", "at", *(F.col(f"v.{c}").alias(c) for c in kept), present.alias("present"))


def previous(samples: DataFrame, columns: list[str], key: str = "point_id", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The samples with previous_<column> of the sample that arrived before; null for a point's first one.

    A point's history is cut by arrival into chunks of ``chunk_rows`` arrivals, of which one row each is passed on, so that a
    point with a large part of all samples is worked on in parallel.
    """
    cut = samples.withColumn("__chunk", F.floor(F.col("ingest_seq") / chunk_rows))
    value = F.struct(*columns)
    in_chunk = Window.partitionBy(key, "__chunk").orderBy("ingest_seq")
    ends = cut.groupBy(key, "__chunk").agg(F.max_by(value, F.col("ingest_seq")).alias("__end"))
    before = Window.partitionBy(key).orderBy("__chunk")
    carried = ends.select(key, "__chunk", F.lag("__end").over(before).alias("__carried"))
    out = cut.withColumn("__lag", F.lag(value).over(in_chunk)).join(carried, [key, "__chunk"]).withColumn("__was", F.coalesce("__lag", "__carried"))
    return out.select(*samples.columns, F.col("__was").isNotNull().alias("has_previous"), *(F.col(f"__was.{c}").alias(f"previous_{c}") for c in columns))


def _changed(samples: DataFrame, chunk_rows: int) -> DataFrame:
    """Samples with ``e``: the kind, field, states and JSON values of each change of health; a first sample has none."""
    q = F.upper(t.text(F.col("quality")))
    known = samples.withColumn("quality", F.when(q == "UNKNOWN", "UNCERTAIN").otherwise(q))
    was = previous(known, ["quality", "overridden", "out_of_service"], chunk_rows=chunk_rows).where("has_previous")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))

    def change(event: str, name: str, column: str, flag: bool) -> Column:
        old, new = F.col(f"previous_{column}"), F.col(column)
        states = (t.python_bool(old), t.python_bool(new)) if flag else (old, new)
        values = (old.cast("string"), new.cast("string")) if flag else (quoted(old), quoted(new))
        return F.struct(F.lit(event).alias("event_type"), F.lit(name).alias("field"), F.lit(column).alias("column"), states[0].alias("previous_state"), states[1].alias("new_state"), values[0].alias("old_value"), values[1].alias("new_value"))

    fields = F.array(
        change("POINT_QUALITY_CHANGED", "quality", "quality", False),
        change("POINT_OVERRIDE_CHANGED", "override", "overridden", True),
        change("POINT_OUT_OF_SERVICE_CHANGED", "out-of-service", "out_of_service", True),
    )
    return was.withColumn("e", F.explode(fields)).where("e.previous_state <> e.new_state")


def _message() -> Column:
    return F.concat(F.lit("Point "), F.col("e.field"), F.lit(" changed from "), F.col("e.previous_state"), F.lit(" to "), F.col("e.new_state"))


def health_changes(samples: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Changes of quality, override and out-of-service from sample to sample; a first sample makes none."""
    changed = _changed(samples, chunk_rows)
    return changed.select("point_id", "ts", "ingest_seq", "value", "e.event_type", "e.previous_state", "e.new_state", _message().alias("message"))


def health_events(samples: DataFrame, points: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The audit events of those changes, at the times of receipt."""
    df = _changed(samples, chunk_rows).join(points.select("point_id", "equipment_id"), "point_id", "left")
    json = F.concat(F.lit('{"changed_field":"'), F.col("e.column"), F.lit('","new_value":'), F.col("e.new_value"), F.lit(',"old_value":'), F.col("e.old_value"), F.lit("}"))
    return audit_events(
        df,
        {
            "point_id": F.col("point_id"),
            "equipment_id": F.coalesce("equipment_id", F.lit("")),
            "event_type": F.col("e.event_type"),
            "event_timestamp": F.col("received_timestamp"),
            "value": F.col("value"),
            "sample_id": F.col("sample_id"),
            "previous_state": F.col("e.previous_state"),
            "new_state": F.col("e.new_state"),
            "acknowledged_by": ACTOR,
            "message": _message(),
            "details_json": json,
        },
    )
