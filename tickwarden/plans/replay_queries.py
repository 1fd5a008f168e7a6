"""Registered queries of the replay: steps and times from the data, rules that change between steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as r
from ..operators import lifecycle, projection
from . import queries as q
from .domain import view
from .queries import query

#: Every seventh sample arrives two days late; steps are of seven, nine and eight hours; those of day 30 and after have names, not numbers.
_SEQUENCE = "CASE WHEN {day}(a) >= 30 THEN concat('late ', CAST(24 - hour(a) AS {string})) ELSE CAST({day}(a) * 3 + CASE WHEN hour(a) < 7 THEN 0 WHEN hour(a) < 16 THEN 1 ELSE 2 END AS {string}) END"
_ARRIVED = "SELECT *, CASE WHEN ingest_seq % 7 = 0 THEN ts + INTERVAL 2 DAY ELSE ts END AS a FROM {samples}"
_FROM = "DATE '2024-01-01' + INTERVAL ({d}) DAY"

#: Versions of the rules: thresholds edited on day 10, disabled from day 12 to 18, gone from day 20 on, and gone from day 8 to 15.
_VERSIONS = f"""
SELECT r.*, {_FROM.format(d=-400)} AS valid_from, CASE WHEN u % 4 = 1 THEN {_FROM.format(d=10)} WHEN u % 5 = 2 THEN {_FROM.format(d=12)} WHEN u % 7 = 3 THEN {_FROM.format(d=20)} WHEN u % 9 = 4 THEN {_FROM.format(d=8)} END AS valid_to FROM {{rules}} r
UNION ALL SELECT r.* {{replace}}(CASE WHEN rule_type = 'analog_limit' THEN '30' ELSE threshold_value END AS threshold_value, CAST(60 AS BIGINT) AS delay_seconds), {_FROM.format(d=10)}, CAST(NULL AS TIMESTAMP{{ntz}}) FROM {{rules}} r WHERE u % 4 = 1
UNION ALL SELECT r.* {{replace}}(false AS enabled), {_FROM.format(d=12)}, {_FROM.format(d=18)} FROM {{rules}} r WHERE u % 4 <> 1 AND u % 5 = 2
UNION ALL SELECT r.*, {_FROM.format(d=18)}, NULL FROM {{rules}} r WHERE u % 4 <> 1 AND u % 5 = 2
UNION ALL SELECT r.*, {_FROM.format(d=15)}, NULL FROM {{rules}} r WHERE u % 4 <> 1 AND u % 5 <> 2 AND u % 7 <> 3 AND u % 9 = 4"""

_STEPS = f"""
arrived AS (SELECT *, {_SEQUENCE.format(day='day', string='VARCHAR')} AS sequence FROM ({_ARRIVED.format(samples='point_samples')})),
steps AS (SELECT sequence, CAST(row_number() OVER (ORDER BY TRY_CAST(sequence AS BIGINT) IS NULL, TRY_CAST(sequence AS BIGINT), sequence) AS BIGINT) AS step, max(source_timestamp) AS step_at FROM arrived GROUP BY sequence),
last AS (SELECT point_id, step, max(ingest_seq) AS ingest_seq FROM arrived JOIN steps USING (sequence) GROUP BY ALL),
seen AS (SELECT p.point_id, g.step, g.step_at, l.ingest_seq FROM points p CROSS JOIN steps g ASOF LEFT JOIN last l ON p.point_id = l.point_id AND g.step >= l.step)"""
_RUN = f"""{_STEPS},
versions AS ({_VERSIONS.format(rules='alarm_rules', replace='REPLACE ', ntz='')}),
grid AS (SELECT f.rule_id, g.step, g.step_at FROM (SELECT rule_id, min(valid_from) AS first FROM versions GROUP BY ALL) f JOIN steps g ON g.step_at >= f.first),
inforce AS (SELECT g.rule_id, g.step, g.step_at, v.point_id, v.rule_type, v.operator, v.threshold_value, v.clear_value, v.enabled, v.delay_seconds, v.severity, v.valid_to IS NULL OR g.step_at < v.valid_to AS present FROM grid g ASOF LEFT JOIN versions v ON g.rule_id = v.rule_id AND g.step_at >= v.valid_from),
evals0 AS (SELECT i.*, s.value, s.quality, s.overridden, s.out_of_service, s.received_timestamp, s.stale_after_seconds, n.ingest_seq AS sample_seq, i.step_at AS eval_at FROM inforce i JOIN seen n ON n.point_id = i.point_id AND n.step = i.step LEFT JOIN point_samples s ON s.ingest_seq = n.ingest_seq),
evals1 AS (SELECT * EXCLUDE (step_at), step_at AS ts, step AS ingest_seq, CASE WHEN NOT present THEN 'Rule not evaluated' ELSE {q._STATUS} END AS status FROM evals0),
evals AS (SELECT *, CASE WHEN NOT present THEN true ELSE {q._CLEARS} END AS clears FROM evals1),{q._STATES.removeprefix(q._EVALS + ",").replace("ORDER BY ts, ingest_seq", "ORDER BY ingest_seq").replace("date_diff('microsecond', since, ts) >= delay_seconds * 1000000", "(delay_seconds <= 0 OR date_diff('microsecond', since, ts) >= delay_seconds * 1000000)")}"""
_VIEWS = ("points", "alarm_rules", "point_samples")


def _arrived(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = view(spark, sf_dir, "point_samples")
    return spark.sql(f"SELECT *, {_SEQUENCE.format(day='day', string='STRING')} AS sequence FROM ({_ARRIVED.format(samples='{samples}')})", samples=samples)


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The versions of all rules, from the rules as they are."""
    rules = view(spark, sf_dir, "alarm_rules")
    day = lambda n: F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=F.lit(n))
    u, none = F.col("u"), F.lit(None).cast("timestamp_ntz")
    one = lambda df, a, b: df.withColumns({"valid_from": a, "valid_to": b})
    ends = F.when(u % 4 == 1, day(10)).when(u % 5 == 2, day(12)).when(u % 7 == 3, day(20)).when(u % 9 == 4, day(8)).otherwise(none)
    edited = rules.where("u % 4 = 1").withColumns({"threshold_value": F.when(F.col("rule_type") == "analog_limit", "30").otherwise(F.col("threshold_value")), "delay_seconds": F.lit(60).cast("bigint")})
    paused = rules.where("u % 4 <> 1 AND u % 5 = 2")
    back = rules.where("u % 4 <> 1 AND u % 5 <> 2 AND u % 7 <> 3 AND u % 9 = 4")
    parts = [one(rules, day(-400), ends), one(edited, day(10), none), one(paused.withColumn("enabled", F.lit(False)), day(12), day(18)), one(paused, day(18), none), one(back, day(15), none)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole replay as one plan: values as of each step by arrival, the rules in force at its time, and the latch over the steps."""
    samples, points = _arrived(spark, sf_dir), view(spark, sf_dir, "points")
    steps = projection.replay_steps(samples)
    values = projection.values_at_steps(samples, steps, points)
    facts = ("value", "quality", "overridden", "out_of_service", "received_timestamp", "source_timestamp", "stale_after_seconds")
    values = values.select("point_id", "step", F.col("sample.ingest_seq").alias("sample_seq"), *(F.col(f"sample.{c}").alias(c) for c in facts))
    rows = projection.rules_at(versions(spark, sf_dir).drop("u"), steps).join(values, ["point_id", "step"])
    evaluated = lifecycle.with_vanished(r.evaluate(rows.withColumn("evaluated_at", F.col("at")))).withColumns({"ts": F.col("at"), "seq": F.col("step")})
    return lifecycle.alarm_states(evaluated, order=("seq",))


@query(f"{_STEPS.lstrip()} SELECT sequence, step, step_at FROM steps", "points", "point_samples")
def replay_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.replay_steps(_arrived(spark, sf_dir)).withColumnRenamed("at", "step_at")


@query(f"{_STEPS.lstrip()} SELECT point_id, step, coalesce(ingest_seq, -1) AS ingest_seq FROM seen", "points", "point_samples")
def replay_values_at_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = _arrived(spark, sf_dir)
    out = projection.values_at_steps(samples, projection.replay_steps(samples), view(spark, sf_dir, "points"))
    return out.select("point_id", "step", F.coalesce("sample.ingest_seq", F.lit(-1)).alias("ingest_seq"))


@query(f"{_RUN.lstrip()} SELECT rule_id, step, ts AS step_at, coalesce(sample_seq, -1) AS sample_seq, status, previous_state, state, episode FROM states WHERE state <> previous_state", *_VIEWS)
def replay_steps_run_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of an alarm's state over the replay: rules are edited, disabled, deleted and come back between steps."""
    return _states(spark, sf_dir).where("state <> previous_state").select("rule_id", "step", F.col("at").alias("step_at"), F.coalesce("sample_seq", F.lit(-1)).alias("sample_seq"), "status", "previous_state", "state", "episode")


@query(
    f"""{_RUN.lstrip()} SELECT step, ts AS step_at, count(*) FILTER (WHERE present) AS evaluated, count(*) FILTER (WHERE previous_state = 'NONE' AND state <> 'NONE') AS created, count(*) FILTER (WHERE state <> 'NONE' AND previous_state <> 'NONE') AS updated,
    count(*) FILTER (WHERE previous_state <> 'NONE' AND state = 'NONE') AS cleared, count(*) FILTER (WHERE NOT present AND previous_state <> 'NONE') AS vanished FROM states GROUP BY step, ts""",
    *_VIEWS,
)
def replay_steps_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    was, now, present = F.col("previous_state") != "NONE", F.col("state") != "NONE", F.col("present")
    counts = {"evaluated": present, "created": ~was & now, "updated": was & now, "cleared": was & ~now, "vanished": ~present & was}
    return _states(spark, sf_dir).groupBy("step", F.col("at").alias("step_at")).agg(*(F.count_if(c).alias(n) for n, c in counts.items()))
