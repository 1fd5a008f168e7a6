"""CSV readers that check their header, typed seeds, register maps with issues, replay steps, simulated samples, and writers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators.events import sample_id
from .csvfiles import csv_files
from .schemas import HEADERS
from .snapshots import Store


class HeaderError(ValueError):
    """Required columns are missing."""


class SurplusCells(ValueError):
    """A row has more cells than the header."""


def read_csv(spark: SparkSession, path: str, required: Iterable[str]) -> DataFrame:
    """The required columns of a CSV file as text, with row_number of its records (the first one is 2).

    Raises FileNotFoundError, or HeaderError with the sorted names that the header lacks. Records with surplus cells say so in ``__surplus``; checked() refuses those.
    """
    required = tuple(sorted(set(required), key=list(required).index))
    rows = csv_files(spark, [path], required)
    if wrong := rows.where("row_number is null").select("issue_field", "issue_message").first():
        if wrong["issue_field"] == "csv_path":
            raise FileNotFoundError(wrong["issue_message"])
        missing = sorted(wrong["issue_message"].partition(": ")[2].split(", "))
        raise HeaderError(f"Missing required CSV columns: {', '.join(missing)}")
    return rows.select(*required, "row_number", F.col("issue_message").alias("__surplus"))


def checked(rows: DataFrame) -> DataFrame:
    """The rows, if none has surplus cells."""
    if bad := rows.where("__surplus is not null").agg(F.min(F.struct("row_number", "__surplus")).alias("b")).first()["b"]:
        raise SurplusCells(f"Row {bad['row_number']}: {bad['__surplus']}")
    return rows.drop("__surplus")


def read_register_maps(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(path, row_number and columns of all records; path, row_number, field and message of what is wrong with the files). Surplus cells are no issue here."""
    rows = csv_files(spark, paths, HEADERS["register_map"])
    issues = rows.where("row_number is null").select("path", "row_number", F.col("issue_field").alias("field"), F.col("issue_message").alias("message"))
    return rows.where("row_number is not null").drop("issue_field", "issue_message"), issues


def _typed(name: str) -> dict[str, Column]:
    c = F.col
    if name == "points":
        return {"unit": t.optional_text(c("unit")), "normal_min": t.optional_number(c("normal_min")), "normal_max": t.optional_number(c("normal_max")), "description": t.optional_text(c("description"))}
    if name == "alarm_rules":
        return {"rule_type": F.lower(t.text(c("rule_type"))), "clear_value": t.optional_text(c("clear_value")), "enabled": t.enabled(c("enabled")), "delay_seconds": t.non_negative_integer(c("delay_seconds")).cast("long")}
    if name == "current_point_values":
        return {"value": t.text(c("value")), "quality": t.loader_quality(c("quality"))}
    if name == "reliability_reports":
        numbers = ("availability_percent", "oos_hours")
        counts = ("critical_alarm_count", "warning_alarm_count", "mttr_minutes", "corrective_actions_open", "corrective_actions_closed", "nuisance_alarm_count")
        return {n: t.number(c(n)) for n in numbers} | {n: t.non_negative_integer(c(n)).cast("long") for n in counts}
    return {}


def read_seed(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A seed file with the types of its table; columns without a type of their own stay text."""
    rows = checked(read_csv(spark, path, HEADERS[name]))
    return rows.withColumns(_typed(name)).drop("row_number")


#: What a load empties, and how a seed value becomes a sample.
RUNTIME = ("generated_alarms", "alarm_events")
LOADER = {"source_default": "SIMULATED", "created_by": "loader", "stale_after_seconds": 300}


def seed_samples(values: DataFrame, points: DataFrame, received_at: Column) -> DataFrame:
    """The seed's current values as samples: units of the catalog (empty for points that it lacks), taken at their update or, where that is blank, at the receipt."""
    units = points.select(F.col("id").alias("point_id"), "unit")
    df = values.withColumn("ingest_seq", F.xxhash64("id")).join(units, "point_id", "left")
    return df.select(
        sample_id(F.col("point_id"), F.col("id")).alias("sample_id"),
        "point_id",
        "value",
        F.coalesce("unit", F.lit("")).alias("unit"),
        "quality",
        F.coalesce(t.timestamp(F.col("updated_at")), received_at).alias("source_timestamp"),
        received_at.alias("received_timestamp"),
        "source",
        F.lit("").alias("protocol"),
        F.lit("").alias("address"),
        F.lit(LOADER["stale_after_seconds"]).cast("bigint").alias("stale_after_seconds"),
        F.lit(False).alias("overridden"),
        F.lit(False).alias("out_of_service"),
        F.lit(LOADER["created_by"]).alias("created_by"),
    )


def load_seeds(spark: SparkSession, folder: str, files: dict[str, str], out: str, received_at: Column | None = None) -> dict[str, int]:
    """Replace the tables of a store by the seed files (table to file name), all of them or none; returns row counts.

    Alarms and events are emptied with them. Where points and current values are loaded, the values become samples too.
    """
    tables = Store(spark, out).begin()
    frames = {name: tables.staged(read_seed(spark, f"{folder}/{file}", name)) for name, file in files.items()}
    counts = {}
    for name, df in frames.items():
        tables.replace(name, df)
        counts[name] = df.count()
    if {"points", "current_point_values"} <= set(frames):
        at = F.lit("1970-01-01").cast("timestamp_ntz") if received_at is None else received_at
        tables.replace("point_samples", seed_samples(frames["current_point_values"], frames["points"], at))
    for name in RUNTIME:
        if tables.has(name):
            tables.replace(name, tables.table(name).limit(0))
    tables.commit()
    return counts


def read_replay(spark: SparkSession, path: str, sequence: str | None = None) -> DataFrame:
    """Replay samples with defaults, of one step or of all; numeric steps come first, in their order."""
    c = F.col
    rows = checked(read_csv(spark, path, HEADERS["replay_samples"]))
    either = lambda name, default: F.when(t.has_value(c(name)), t.text(c(name))).otherwise(default).alias(name)
    out = rows.select(
        t.text(c("sequence")).alias("sequence"),
        t.text(c("point_id")).alias("point_id"),
        t.text(c("value")).alias("value"),
        either("quality", "GOOD"),
        t.text(c("source_timestamp")).alias("source_timestamp"),
        either("source", "SIMULATED"),
        either("protocol", "CSV_REPLAY"),
        t.text(c("address")).alias("address"),
        t.text(c("stale_after_seconds")).alias("stale_after_seconds"),
        t.replay_flag(c("overridden")).alias("overridden"),
        t.replay_flag(c("out_of_service")).alias("out_of_service"),
        "row_number",
    )
    if sequence is not None:
        if isinstance(sequence, bool) or not str(sequence).strip():
            raise ValueError("sequence is required")
        out = out.where(c("sequence") == str(sequence).strip())
    return in_replay_order(out)


def in_replay_order(df: DataFrame) -> DataFrame:
    number = F.col("sequence").try_cast("bigint")
    return df.orderBy(number.isNull(), number, "sequence", "row_number")


def replay_sequences(samples: DataFrame) -> DataFrame:
    """The distinct steps in the order in which they are replayed: by number, then by text."""
    number = F.col("sequence").try_cast("bigint")
    return samples.select("sequence").distinct().orderBy(number.isNull(), number, "sequence")


def simulated_samples(spark: SparkSession, at: str) -> DataFrame:
    """Three samples with one time stamp."""
    rows = [("SIM_LOAD_KW", "210", "kW"), ("SIM_SUPPLY_TEMP", "18.5", "C"), ("SIM_RUN_STATUS", "true", "")]
    df = spark.createDataFrame(rows, "point_id string, value string, unit string")
    return df.withColumns({"quality": F.lit("GOOD"), "source": F.lit("SIMULATED"), "source_timestamp": F.lit(at).cast("timestamp_ntz")})


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows without those whose key is new, and the new rows; one row a key in each is the caller's duty."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_or_ignore(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The new rows whose key is not there yet."""
    return new.dropDuplicates([key]).join(old.select(key), key, "left_anti")


def with_columns(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Schema evolution: columns that an older file lacks get their default."""
    return df.withColumns({c: v for c, v in defaults.items() if c not in df.columns})
