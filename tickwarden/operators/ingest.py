"""Normalising, checking and appending samples; increments, health sweeps, what-if scenarios, resets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as r
from ..functions import text as t
from ..sources.snapshots import Transaction
from .events import ACTOR, audit_events, details, sample_id, time_text
from .projection import health_events, latest

#: Fields that a raw sample may lack, and what they count as then. A field that is there but null counts as not given.
DEFAULTS = {"quality": "GOOD", "source": "SIMULATED", "unit": "", "source_timestamp": "", "received_timestamp": "", "protocol": "SIMULATED", "address": "", "stale_after_seconds": "", "overridden": "", "out_of_service": "", "created_by": "simulated-driver"}


def checked_samples(raw: DataFrame, points: DataFrame, received_at: Column, default_source: str = "SIMULATED") -> DataFrame:
    """Normalised samples with ``error``: null for good rows, else the first thing that is wrong with the row.

    Quality, source, window and flags are looked at in this order, then whether the point is known; the other rows go on. Values may be blank. A
    source time that is blank is the time of receipt; one that is no time is null, and the sample's age counts from its receipt.
    """
    given = {c: F.coalesce(F.col(c).cast("string"), F.lit(d)) if c in raw.columns else F.lit(d) for c, d in (DEFAULTS | {"source": default_source}).items()}
    df = raw.join(points.select(F.col("point_id").alias("__known"), F.col("unit").alias("__unit")), F.coalesce("point_id", F.lit("")) == F.col("__known"), "left")
    flag = lambda c: F.when(t.text(given[c]) == "", False).otherwise(t.boolean(given[c]))
    stale = F.when(t.has_value(given["stale_after_seconds"]), t.non_negative_integer(given["stale_after_seconds"])).otherwise(t.DEFAULT_STALE_AFTER)
    received = F.coalesce(t.timestamp(given["received_timestamp"]), received_at)
    put = {
        "quality": t.ingest_quality(given["quality"]),
        "source": t.value_source(given["source"]),
        "stale": stale.cast("bigint"),
        "overridden": flag("overridden"),
        "out_of_service": flag("out_of_service"),
        "received": received,
        "taken": F.when(t.text(given["source_timestamp"]) == "", received).otherwise(t.timestamp(given["source_timestamp"])),
    }
    df = df.select("*", *(c.alias(f"__{n}") for n, c in put.items()))
    wrong = lambda c, said: F.when(F.col(f"__{c}").isNull(), said if isinstance(said, Column) else F.lit(said))
    error = F.coalesce(
        wrong("quality", f"quality must be one of: {', '.join(sorted(t.QUALITIES))}, UNKNOWN"),
        wrong("source", f"source must be one of: {', '.join(sorted(t.SOURCES))}"),
        wrong("stale", "delay_seconds must be a non-negative integer"),
        wrong("overridden", "overridden must be a boolean value"),
        wrong("out_of_service", "out_of_service must be a boolean value"),
        wrong("known", F.concat(F.lit("Point not found: "), F.coalesce("point_id", F.lit("")))),
    )
    unit = t.text(given["unit"])
    return df.select(
        "ingest_seq",
        sample_id(F.col("point_id"), F.col("ingest_seq")).alias("sample_id"),
        "point_id",
        t.text(F.col("value")).alias("value"),
        F.when(t.has_value(unit), unit).otherwise(F.col("__unit")).alias("unit"),
        F.col("__quality").alias("quality"),
        F.col("__taken").alias("source_timestamp"),
        F.col("__received").alias("received_timestamp"),
        F.col("__source").alias("source"),
        t.text(given["protocol"]).alias("protocol"),
        t.text(given["address"]).alias("address"),
        F.col("__stale").alias("stale_after_seconds"),
        F.col("__overridden").alias("overridden"),
        F.col("__out_of_service").alias("out_of_service"),
        F.when(t.text(given["created_by"]) == "", ACTOR).otherwise(t.text(given["created_by"])).alias("created_by"),
        error.alias("error"),
    )


def split_checked(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(samples to append, quarantine of index, point_id and error)."""
    return checked.where("error is null").drop("error"), checked.where("error is not null").select(F.col("ingest_seq").alias("index"), "point_id", "error")


def ingest_increment(tables: Transaction, raw: DataFrame, received_at: Column, default_source: str = "SIMULATED") -> None:
    """Samples into ``point_samples``, their failures into ``failed_samples``, the last value of each point into ``current_point_values`` and changes of health into ``alarm_events``.

    Increments come in the order of arrival. Of what came before only the stored values of the increment's own points are read, and only
    the buckets that they lie in are written anew. All four tables change with the transaction, or none.
    """
    points = tables.table("points")
    rows = tables.staged(checked_samples(raw, points, received_at, default_source))
    good, bad = split_checked(rows)
    tables.append("point_samples", good)
    tables.append("failed_samples", bad)
    tables.append("alarm_events", increment_events(tables.table("current_point_values") if tables.has("current_point_values") else None, good, points))
    tables.upsert("current_point_values", latest(good), "point_id")


def increment_events(current: DataFrame | None, samples: DataFrame, points: DataFrame) -> DataFrame:
    """Changes of health from the stored values to the samples and from sample to sample."""
    df = samples
    if current is not None:
        df = current.join(samples.select("point_id").distinct(), "point_id", "left_semi").select(*samples.columns).unionByName(samples)
    events = health_events(df, points)
    return events if current is None else events.join(samples.select("sample_id"), "sample_id", "left_semi").select(*events.columns)


def step_counters(checked: DataFrame, *steps: str) -> DataFrame:
    """Ingested and failed rows of each step, and of all steps together (a null step)."""
    return checked.rollup(*steps).agg(F.count_if(F.col("error").isNull()).alias("ingested"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def updated_points(checked: DataFrame, step: str) -> DataFrame:
    """The ids of the points that each step ingested, sorted; steps whose rows all failed have none."""
    ids = F.array_sort(F.collect_set(F.when(F.col("error").isNull() & (t.text(F.col("point_id")) != ""), t.text(F.col("point_id")))))
    return checked.groupBy(step).agg(ids.alias("points_updated"))


def stale_points(current: DataFrame, at: Column) -> DataFrame:
    """Current values that are stale at a time, by their quality or their age."""
    old = r.is_stale(F.col("received_timestamp"), F.col("source_timestamp"), F.col("stale_after_seconds"), at)
    return current.where((F.upper(t.text(F.col("quality"))) == "STALE") | old)


def first_stale(sweeps: DataFrame) -> DataFrame:
    """One event for each (point, sample) however many sweeps find it: the first of them."""
    return sweeps.groupBy("point_id", "ingest_seq").agg(F.min("tick").alias("tick"), F.count("*").alias("sweeps"))


def sweep_counters(seen: DataFrame) -> DataFrame:
    """checked, stale and new_events of each tick, from the values as of the ticks; a sample's event is new at the first tick that finds it stale."""
    old = r.is_stale(F.col("received_timestamp"), F.col("source_timestamp"), F.col("stale_after_seconds"), F.col("tick"))
    stale = (F.upper(t.text(F.col("quality"))) == "STALE") | old
    first = F.min(F.when(F.col("stale"), F.col("tick"))).over(Window.partitionBy("point_id", "ingest_seq"))
    rows = seen.select("point_id", "ingest_seq", "tick", stale.alias("stale")).withColumn("new", F.col("stale") & (F.col("tick") == first))
    return rows.groupBy("tick").agg(F.count("*").alias("checked"), F.count_if("stale").alias("stale"), F.count_if("new").alias("new_events"))


def stale_events(stale: DataFrame, points: DataFrame, at: Column) -> DataFrame:
    """POINT_STALE for each row; rows have the sample's facts."""
    named = points.select("point_id", "point_name", "display_name", "equipment_id")
    df = stale.join(named, "point_id", "left")
    facts = {c: F.col(c) for c in ("quality", "source", "stale_after_seconds")} | {c: time_text(F.col(c)) for c in ("source_timestamp", "received_timestamp")} | {"evaluation_timestamp": time_text(at)}
    name = F.coalesce(F.nullif(F.col("display_name"), F.lit("")), F.col("point_name"), F.lit("None"))
    return audit_events(
        df,
        {
            "point_id": F.col("point_id"),
            "equipment_id": F.coalesce("equipment_id", F.lit("")),
            "event_type": "POINT_STALE",
            "event_timestamp": at,
            "value": F.col("value"),
            "sample_id": F.col("sample_id"),
            "previous_state": "Not stale",
            "new_state": "Stale",
            "acknowledged_by": ACTOR,
            "message": F.concat(F.lit("Point sample is stale: "), name),
            "details_json": details(facts),
        },
    )


def health_sweep(tables: Transaction, at: Column) -> None:
    """POINT_STALE for each current value that is stale at a time and whose sample has no such event yet."""
    known = tables.table("alarm_events").where("event_type = 'POINT_STALE'").select("point_id", "sample_id")
    new = stale_points(tables.table("current_point_values"), at).join(known, ["point_id", "sample_id"], "left_anti")
    tables.append("alarm_events", stale_events(new, tables.table("points"), at))


def refusals(updates: DataFrame, points: DataFrame, group: str = "scenario_id") -> DataFrame:
    """The groups that may not be applied, with the reason: the first of their updates (by ``position``) that no ingest would take."""
    at = F.lit("1970-01-01").cast("timestamp_ntz")
    checked = checked_samples(updates.withColumn("ingest_seq", F.struct(group, "position")), points, at, "SCENARIO").where("error is not null")
    return checked.groupBy(F.col(f"ingest_seq.{group}").alias(group)).agg(F.min_by("error", F.col("ingest_seq.position")).alias("error"))


def with_scenarios(current: DataFrame, updates: DataFrame, points: DataFrame, at: Column, group: str = "scenario_id") -> DataFrame:
    """Current values after the updates of whole groups, which arrive after everything else, in the order of ``position``.

    A group with an update that can't be ingested changes nothing, whichever of its updates it is (``refusals`` says why). A point without a
    value gets one. ``from_scenario`` says which rows are new.
    """
    fit = updates.join(refusals(updates, points, group), group, "left_anti")
    last = F.max_by(F.struct(*(F.col(c) for c in fit.columns)), F.struct(group, "position"))
    taken = fit.groupBy(F.col("point_id").alias("__point")).agg(last.alias("u")).select("u.*").drop(group, "position").withColumn("ingest_seq", F.lit(None).cast("bigint"))
    new = checked_samples(taken, points, at, "SCENARIO").drop("error")
    kept = current.join(new.select("point_id"), "point_id", "left_anti").select(*(F.col(c) if c in current.columns else F.lit(None).cast(new.schema[c].dataType).alias(c) for c in new.columns), F.lit(False).alias("from_scenario"))
    return kept.unionByName(new.withColumn("from_scenario", F.lit(True)))


def apply_scenario(tables: Transaction, updates: DataFrame, received_at: Column, group: str = "scenario_id") -> DataFrame:
    """Ingest the updates of all groups that have no refusal, in the order of (group, position); returns the refusals."""
    refused = tables.staged(refusals(updates, tables.table("points"), group))
    fit = updates.join(refused, group, "left_anti").withColumn("ingest_seq", F.col("position")).drop("position", group)
    ingest_increment(tables, fit, received_at, "SCENARIO")
    return refused


def reset(tables: Transaction, samples: DataFrame) -> None:
    """Operational tables as at the start: samples and current values from the seed, no alarms, no events, no failures. The catalog stays."""
    tables.replace("point_samples", samples)
    tables.replace("current_point_values", latest(samples), "point_id")
    for name in ("generated_alarms", "alarm_events", "failed_samples"):
        if tables.has(name):
            tables.replace(name, tables.table(name).limit(0))
