"""Markdown briefing of an alarm log: total, counts and what is active and critical, each section whole.

The lines are rows with their place (section, then the section's own order); Spark sorts them by ranges and writes a part for each range, so that a
section may be of any length. Read in the order of their names, the parts are the text. Nothing but the total passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The follow-up of every briefing.
FOLLOW_UP = (
    "Review active Critical alarms first.",
    "Check for repeated alarms on the same equipment.",
    "Compare BMS alarms against EPMS events when power and cooling issues occur near the same time.",
    "Confirm whether repeated alarms represent actual equipment issues, nuisance alarms, or communication problems.",
)
COUNTS = (("severity", "Alarm Count by Severity"), ("source", "Alarm Count by Source"), ("equipment", "Most Frequent Equipment in Alarm"))


def briefing_lines(log: DataFrame, title: str = "Daily Facility Operations Briefing") -> DataFrame:
    """section, first (a number), key (texts, compared one after the other) and line, of a log with severity, source, equipment, alarm, status and timestamp; sorted by the first three the lines are the text."""
    spark = log.sparkSession

    def rows(df: DataFrame, section: int, first: Column, key: list[Column], line: Column) -> DataFrame:
        return df.select(F.lit(section).alias("section"), first.cast("bigint").alias("first"), F.array(*(F.coalesce(k.cast("string"), F.lit("")) for k in key)).alias("key"), line.alias("line"))

    def plain(section: int, *lines: str) -> DataFrame:
        return rows(spark.range(1).select(F.posexplode(F.array(*map(F.lit, lines))).alias("i", "x")), section, F.col("i"), [F.lit("")], F.col("x"))

    total = log.agg(F.count("*").alias("n"))
    parts = [plain(0, f"# {title}", "", "## Executive Summary", ""), rows(total, 1, F.lit(0), [F.lit("")], F.concat(F.lit("The alarm log contains "), F.col("n"), F.lit(" total alarm records.")))]
    for i, (column, heading) in enumerate(COUNTS):
        counted = log.groupBy(column).agg(F.count("*").alias("n"))
        parts += [plain(2 + 2 * i, "", f"## {heading}", ""), rows(counted, 3 + 2 * i, -F.col("n"), [F.col(column)], F.concat(F.lit("- "), F.coalesce(F.col(column).cast("string"), F.lit("None")), F.lit(": "), F.col("n")))]
    active = log.where("severity = 'Critical' and status = 'Active'")
    shown = [F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in ("timestamp", "source", "equipment", "alarm")]
    none = active.limit(1).agg(F.count("*").alias("n")).where("n = 0")
    parts += [
        plain(8, "", "## Active Critical Alarms", ""),
        rows(active, 9, F.lit(0), [F.col(c) for c in ("timestamp", "source", "equipment", "alarm")], F.concat(F.lit("- "), F.concat_ws(" | ", *shown))),
        rows(none, 9, F.lit(1), [F.lit("")], F.lit("- No active critical alarms found.")),
        plain(10, "", "## Operator Follow-Up", "", *(f"- {x}" for x in FOLLOW_UP)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_briefing(log: DataFrame, path: str, title: str = "Daily Facility Operations Briefing") -> None:
    """The lines as text files in a folder."""
    order = ("section", "first", "key")
    briefing_lines(log, title).repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.text(path)
