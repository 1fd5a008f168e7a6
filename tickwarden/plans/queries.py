"""The registered queries of the telemetry domain, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as r
from ..functions import text as t
from ..operators import catalog, importer, ingest, lifecycle, projection
from ..operators.events import sample_id
from ..sources import files
from . import domain, readmodels
from .domain import STALE_SECONDS, TICK_SECONDS, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str, *views: str) -> Callable[[Query], Query]:
    """Register a query with the SQL that gives the same rows; ``views`` are the domain tables that it reads."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ctes = domain.duckdb(*views)
        ORACLE[f.__name__] = f"WITH {ctes}{',' if ctes and not sql.lstrip().upper().startswith('SELECT') else ''}\n{sql}" if ctes else sql
        return f

    return register


# --- pieces of SQL that several queries share ---------------------------------------------

_STATUS = """CASE WHEN NOT enabled THEN 'Disabled'
            WHEN value IS NULL OR lower(trim(value)) IN ('', 'null', 'none', 'n/a') THEN 'No current value'
            WHEN overridden THEN 'OVERRIDDEN' WHEN out_of_service THEN 'OUT_OF_SERVICE'
            WHEN quality = 'BAD' THEN 'BAD_QUALITY' WHEN quality = 'STALE' THEN 'STALE' WHEN quality <> 'GOOD' THEN 'UNCERTAIN_QUALITY'
            WHEN date_diff('microsecond', received_timestamp, eval_at) > stale_after_seconds * 1000000 THEN 'STALE'
            WHEN rule_type = 'analog_limit' THEN CASE WHEN (operator = '>' AND CAST(value AS DOUBLE) > CAST(threshold_value AS DOUBLE)) OR (operator = '<' AND CAST(value AS DOUBLE) < CAST(threshold_value AS DOUBLE)) THEN 'Triggered' ELSE 'Normal' END
            WHEN rule_type = 'boolean_state' THEN CASE WHEN (lower(value) IN ('true', '1', 'yes', 'on')) = (lower(threshold_value) IN ('true', '1', 'yes', 'on')) THEN 'Triggered' ELSE 'Normal' END
            ELSE CASE WHEN lower(trim(value)) = lower(trim(threshold_value)) THEN 'Triggered' ELSE 'Normal' END END"""
_CLEARS = """CASE status WHEN 'Disabled' THEN true WHEN 'Triggered' THEN false WHEN 'Normal' THEN
            CASE WHEN rule_type <> 'analog_limit' THEN true WHEN operator = '>' THEN CAST(value AS DOUBLE) < CAST(clear_value AS DOUBLE) ELSE CAST(value AS DOUBLE) > CAST(clear_value AS DOUBLE) END
            WHEN 'No current value' THEN true ELSE false END"""
_EVALS = f"""
evals0 AS (SELECT s.*, r.rule_id, r.rule_type, r.operator, r.threshold_value, r.clear_value, r.enabled, r.delay_seconds, r.severity, s.ts AS eval_at
           FROM point_samples s JOIN alarm_rules r ON s.point_id = r.point_id),
evals1 AS (SELECT *, {_STATUS} AS status FROM evals0),
evals AS (SELECT *, {_CLEARS} AS clears FROM evals1)"""
_STATES = f"""{_EVALS},
t1 AS (SELECT *, status = 'Triggered' AS trig, lag(status = 'Triggered', 1, false) OVER w AS was FROM evals WINDOW w AS (PARTITION BY rule_id ORDER BY ts, ingest_seq)),
t2 AS (SELECT *, last_value(CASE WHEN trig AND NOT was THEN ts END IGNORE NULLS) OVER w AS since FROM t1 WINDOW w AS (PARTITION BY rule_id ORDER BY ts, ingest_seq ROWS UNBOUNDED PRECEDING)),
t3 AS (SELECT *, CASE WHEN trig AND date_diff('microsecond', since, ts) >= delay_seconds * 1000000 THEN 1 WHEN NOT trig AND clears THEN 0 END AS latch FROM t2),
t4 AS (SELECT *, coalesce(last_value(latch IGNORE NULLS) OVER w, 0) AS latched FROM t3 WINDOW w AS (PARTITION BY rule_id ORDER BY ts, ingest_seq ROWS UNBOUNDED PRECEDING)),
t5 AS (SELECT *, CASE WHEN latched = 1 THEN 'ACTIVE' WHEN trig THEN 'PENDING' ELSE 'NONE' END AS state FROM t4),
t6 AS (SELECT *, lag(state, 1, 'NONE') OVER w AS previous_state FROM t5 WINDOW w AS (PARTITION BY rule_id ORDER BY ts, ingest_seq)),
states AS (SELECT *, CAST(sum(CASE WHEN previous_state = 'NONE' AND state <> 'NONE' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS episode FROM t6 WINDOW w AS (PARTITION BY rule_id ORDER BY ts, ingest_seq ROWS UNBOUNDED PRECEDING))"""
_ALARMS = f"""{_STATES},
alarms AS (
  SELECT rule_id, episode, min(ts) AS created_at, min(CASE WHEN state = 'PENDING' THEN ts END) AS pending_started_at, min(CASE WHEN state = 'ACTIVE' THEN ts END) AS triggered_at,
         max(CASE WHEN state = 'NONE' THEN ts END) AS cleared_at, max(ts) AS last_evaluated_at,
         CASE WHEN max(CASE WHEN state = 'NONE' THEN ts END) IS NOT NULL THEN 'CLEARED' ELSE arg_max(state, ingest_seq) END AS state, count(*) AS evaluations
  FROM states WHERE state <> 'NONE' OR previous_state <> 'NONE' GROUP BY rule_id, episode)"""
_EVENTS = f"""{_STATES},
transitions AS (
  SELECT rule_id, point_id, ts, ingest_seq, value, episode,
         CASE state WHEN 'PENDING' THEN 'PENDING_CREATED' WHEN 'ACTIVE' THEN 'ALARM_ACTIVATED' ELSE 'ALARM_CLEARED' END AS event_type,
         CASE previous_state WHEN 'NONE' THEN '' ELSE previous_state END AS event_previous_state, CASE state WHEN 'NONE' THEN 'CLEARED' ELSE state END AS event_new_state
  FROM states WHERE state <> previous_state)"""
_BASE = ("alarm_rules", "point_samples")


def _evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sample against the rule of its point, at the sample's own time."""
    samples, rules = view(spark, sf_dir, "point_samples"), view(spark, sf_dir, "alarm_rules").drop("u")
    return _evaluated(samples.join(rules, "point_id"), F.col("ts")).withColumn("seq", F.col("ingest_seq"))


def _evaluated(df: DataFrame, at) -> DataFrame:
    return r.evaluate(df.withColumn("evaluated_at", at))


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.alarm_states(_evaluations(spark, sf_dir))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.transitions(_states(spark, sf_dir))


# --- catalogs and current values ----------------------------------------------------------


@query("SELECT * FROM equipment", "equipment")
def equipment_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readmodels.equipment_inventory(view(spark, sf_dir, "equipment"))


_EQ = "coalesce(e.equipment_type, '{d}') AS equipment_type, coalesce(e.location, '{d}') AS location, coalesce(e.criticality, '{d}') AS criticality, coalesce(e.source_system, '{d}') AS equipment_source_system"


@query(f"SELECT p.*, {_EQ.format(d='Unknown')} FROM points p LEFT JOIN equipment e ON p.equipment_id = e.equipment", "points", "equipment")
def point_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readmodels.point_dictionary(view(spark, sf_dir, "points"), view(spark, sf_dir, "equipment"))


@query(
    f"SELECT r.rule_id, r.rule_name, r.rule_type, r.operator, r.threshold_value, r.clear_value, r.severity, r.enabled, r.delay_seconds, p.point_id, p.point_name, p.equipment_id, p.unit AS point_unit, {_EQ.format(d='Unknown')} FROM alarm_rules r LEFT JOIN points p ON r.point_id = p.point_id LEFT JOIN equipment e ON p.equipment_id = e.equipment",
    "points",
    "equipment",
    "alarm_rules",
)
def rule_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = readmodels.rule_catalog(view(spark, sf_dir, "alarm_rules"), view(spark, sf_dir, "points"), view(spark, sf_dir, "equipment"))
    return out.drop("u", "alarm_message", "display_name")


@query(
    f"""latest AS (SELECT * FROM point_samples QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY ingest_seq DESC) = 1)
SELECT s.point_id, s.value, s.quality, s.ts, s.ingest_seq, p.point_name, p.unit, p.data_type, p.equipment_id, {_EQ.format(d='Unknown')}
FROM latest s LEFT JOIN points p ON s.point_id = p.point_id LEFT JOIN equipment e ON p.equipment_id = e.equipment""",
    "points",
    "equipment",
    "point_samples",
)
def current_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = readmodels.current_values(projection.latest(view(spark, sf_dir, "point_samples")), view(spark, sf_dir, "points"), view(spark, sf_dir, "equipment"))
    return out.select("point_id", "value", "quality", "ts", "ingest_seq", "point_name", "unit", "data_type", "equipment_id", "equipment_type", "location", "criticality", "equipment_source_system")


# --- evaluation ---------------------------------------------------------------------------


@query(
    f"""latest AS (SELECT * FROM point_samples QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY ingest_seq DESC) = 1),
e0 AS (SELECT r.rule_id, r.rule_type, r.operator, r.threshold_value, r.clear_value, r.enabled, s.*, (SELECT max(ts) FROM point_samples) AS eval_at FROM alarm_rules r LEFT JOIN latest s ON r.point_id = s.point_id),
e1 AS (SELECT *, {_STATUS} AS status FROM e0)
SELECT rule_id, rule_type, value, status, status = 'Triggered' AS is_triggered FROM e1""",
    *_BASE,
)
def rule_evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = view(spark, sf_dir, "point_samples")
    at = samples.agg(F.max("ts").alias("at"))  # one row
    rules = view(spark, sf_dir, "alarm_rules").join(projection.latest(samples), "point_id", "left").crossJoin(F.broadcast(at))
    out = _evaluated(rules, F.col("at"))
    return out.select("rule_id", "rule_type", "value", "status", (F.col("status") == "Triggered").alias("is_triggered"))


@query(f"{_EVALS} SELECT rule_type, status, count(*) AS n FROM evals GROUP BY ALL", *_BASE)
def eligibility_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluations(spark, sf_dir).groupBy("rule_type", "status").agg(F.count("*").alias("n"))


_TICKS = f"""
span AS (SELECT min(date_trunc('day', ts)) AS a, max(ts) AS b FROM point_samples),
grid AS (SELECT p.point_id, g.tick FROM points p, span, LATERAL (SELECT unnest(generate_series(span.a, span.b, INTERVAL {TICK_SECONDS} SECOND)) AS tick) g),
seen AS (SELECT g.point_id, g.tick, s.ingest_seq, s.value, s.quality, s.overridden, s.out_of_service, s.received_timestamp, s.stale_after_seconds
         FROM grid g ASOF LEFT JOIN point_samples s ON g.point_id = s.point_id AND g.tick >= s.ts)"""


def _as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = view(spark, sf_dir, "point_samples")
    span = samples.agg(F.date_trunc("day", F.min("ts")).cast("timestamp_ntz").alias("a"), F.max("ts").alias("b"))  # one row
    points = view(spark, sf_dir, "points").select("point_id").crossJoin(F.broadcast(span))
    return projection.as_of_ticks(samples, points, F.col("a"), F.col("b"), TICK_SECONDS)


@query(f"{_TICKS} SELECT point_id, tick, coalesce(ingest_seq, -1) AS ingest_seq, value, quality FROM seen", "points", "point_samples")
def asof_values_at_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_of(spark, sf_dir).select("point_id", "tick", F.coalesce("sample.ingest_seq", F.lit(-1)).alias("ingest_seq"), "sample.value", "sample.quality")


@query(
    f"{_TICKS}, e0 AS (SELECT r.rule_id, r.rule_type, r.operator, r.threshold_value, r.enabled, a.*, a.tick AS eval_at FROM alarm_rules r JOIN seen a ON r.point_id = a.point_id), e1 AS (SELECT *, {_STATUS} AS status FROM e0) SELECT tick, status, count(*) AS n FROM e1 GROUP BY ALL",
    "points",
    *_BASE,
)
def rule_evaluations_at_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = _as_of(spark, sf_dir).select("point_id", "tick", *(F.col(f"sample.{c}").alias(c) for c in ("value", "quality", "overridden", "out_of_service", "received_timestamp", "source_timestamp", "stale_after_seconds")))
    out = _evaluated(values.join(view(spark, sf_dir, "alarm_rules"), "point_id"), F.col("tick"))
    return out.groupBy("tick", "status").agg(F.count("*").alias("n"))


# --- lifecycle ----------------------------------------------------------------------------


@query(f"{_STATES} SELECT rule_id, ts, ingest_seq, status, previous_state, state, episode FROM states", *_BASE)
def alarm_state_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _states(spark, sf_dir).select("rule_id", "ts", "ingest_seq", "status", "previous_state", "state", "episode")


@query(f"{_EVENTS} SELECT rule_id, ts, ingest_seq, value, episode, event_type, event_previous_state, event_new_state FROM transitions", *_BASE)
def alarm_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("rule_id", "ts", "ingest_seq", "value", "episode", "event_type", "event_previous_state", "event_new_state")


@query(f"{_ALARMS} SELECT * FROM alarms", *_BASE)
def alarm_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.episodes(_states(spark, sf_dir))


@query(
    f"""{_STATES}, o AS (SELECT s.*, r.rule_name, r.alarm_message FROM states s JOIN alarm_rules r USING (rule_id) WHERE previous_state = 'NONE' AND state <> 'NONE')
SELECT rule_id, episode, rule_name AS rule_name_at_trigger, rule_type AS rule_type_at_trigger, operator AS operator_at_trigger, threshold_value AS threshold_value_at_trigger, clear_value AS clear_value_at_trigger, delay_seconds AS delay_seconds_at_trigger,
       severity AS severity_at_trigger, alarm_message AS alarm_message_at_trigger, concat('PS-', point_id, '-', substr(sha256(concat_ws('|', point_id, CAST(ingest_seq AS VARCHAR))), 1, 12)) AS triggering_sample_id, value AS triggering_value, quality AS triggering_quality,
       source_timestamp AS triggering_source_timestamp, received_timestamp AS triggering_received_timestamp FROM o""",
    *_BASE,
)
def alarm_episode_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.episodes(_states(spark, sf_dir).withColumn("sample_id", sample_id(F.col("point_id"), F.col("ingest_seq"))), lifecycle.SNAPSHOT).select("rule_id", "episode", *lifecycle.SNAPSHOT)


@query(
    f"""{_STATES}, l AS (SELECT * FROM states WHERE state <> 'NONE' QUALIFY row_number() OVER (PARTITION BY rule_id, episode ORDER BY ts DESC, ingest_seq DESC) = 1)
SELECT rule_id, episode, CASE WHEN rule_type = 'analog_limit' AND clear_value <> '' AND status = 'Normal' THEN 'Waiting for clear value' ELSE status END AS evaluation_note FROM l""",
    *_BASE,
)
def alarm_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = r.note_while_active(F.col("status"), F.col("rule_type"), F.col("clear_value"))
    open_rows = _states(spark, sf_dir).where(F.col("state") != lifecycle.NONE)
    return open_rows.groupBy("rule_id", "episode").agg(F.max_by(note, F.struct("ts", "seq")).alias("evaluation_note"))


@query(
    f"""{_ALARMS}, a AS (SELECT a.*, r.severity, p.equipment_id FROM alarms a JOIN alarm_rules r USING (rule_id) JOIN points p USING (point_id))
SELECT count(*) AS generated, count(*) FILTER (WHERE state = 'ACTIVE') AS active, count(*) FILTER (WHERE state = 'PENDING') AS pending, count(*) FILTER (WHERE state = 'CLEARED') AS cleared,
       count(*) FILTER (WHERE state = 'ACTIVE' AND severity = 'Critical') AS active_critical, count(DISTINCT CASE WHEN state = 'ACTIVE' THEN equipment_id END) AS equipment_in_alarm FROM a""",
    "points",
    *_BASE,
)
def alarm_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, active = F.col("state"), F.col("state") == "ACTIVE"
    return _alarms(spark, sf_dir).agg(
        F.count("*").alias("generated"),
        *(F.count_if(state == s).alias(s.lower()) for s in ("ACTIVE", "PENDING", "CLEARED")),
        F.count_if(active & (F.col("severity") == "Critical")).alias("active_critical"),
        F.countDistinct(F.when(active, F.col("equipment_id"))).alias("equipment_in_alarm"),
    )


def _alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alarms with severity and equipment of their rules."""
    points = view(spark, sf_dir, "points").select("point_id", "equipment_id")
    rules = view(spark, sf_dir, "alarm_rules").select("rule_id", "point_id", "severity").join(points, "point_id")
    return lifecycle.episodes(_states(spark, sf_dir)).join(rules, "rule_id")


_COUNT = "{a}, a AS (SELECT a.*, r.severity, p.equipment_id FROM alarms a JOIN alarm_rules r USING (rule_id) JOIN points p USING (point_id)) SELECT {c} AS key, count(*) AS n FROM a {w} GROUP BY 1"


@query(_COUNT.format(a=_ALARMS, c="severity", w=""), "points", *_BASE)
def alarm_counts_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readmodels.counts_by(_alarms(spark, sf_dir), "severity")


@query(_COUNT.format(a=_ALARMS, c="state", w=""), "points", *_BASE)
def alarm_counts_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readmodels.counts_by(_alarms(spark, sf_dir), "state")


@query(_COUNT.format(a=_ALARMS, c="equipment_id", w="WHERE state = 'CLEARED'"), "points", *_BASE)
def alarm_counts_by_equipment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readmodels.counts_by(readmodels.filtered_alarms(_alarms(spark, sf_dir), state="CLEARED"), "equipment_id")


@query(
    f"{_EVENTS} SELECT t.rule_id, t.point_id, t.ts, t.event_type, t.value, coalesce(r.rule_name, '') AS rule_name, coalesce(r.severity, '') AS severity, coalesce(p.point_name, '') AS point_name, coalesce(p.equipment_id, '') AS equipment_id, {_EQ.format(d='')} FROM transitions t LEFT JOIN alarm_rules r USING (rule_id) LEFT JOIN points p ON t.point_id = p.point_id LEFT JOIN equipment e ON p.equipment_id = e.equipment",
    "points",
    "equipment",
    *_BASE,
)
def alarm_events_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir).select("rule_id", "point_id", "ts", "event_type", "value")
    return readmodels.events_enriched(events, view(spark, sf_dir, "alarm_rules"), view(spark, sf_dir, "points"), view(spark, sf_dir, "equipment"))


@query(
    f"{_ALARMS}, k AS (SELECT rule_id, episode, created_at + INTERVAL 1 HOUR AS acknowledged_at FROM alarms WHERE episode % 3 = 0) SELECT a.state, k.rule_id IS NOT NULL AS acknowledged, CASE WHEN k.rule_id IS NULL THEN '' ELSE 'local-operator' END AS acknowledged_by, count(*) AS n, max(k.acknowledged_at) AS last_acknowledged_at FROM alarms a LEFT JOIN k USING (rule_id, episode) GROUP BY ALL",
    *_BASE,
)
def acknowledgement_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    alarms = lifecycle.episodes(_states(spark, sf_dir))
    commands = alarms.where("episode % 3 = 0").select("rule_id", "episode", F.expr("created_at + INTERVAL 1 HOUR").alias("acknowledged_at"), F.lit("  ").alias("operator"))
    out = lifecycle.acknowledge(alarms, commands)
    return out.groupBy("state", "acknowledged", "acknowledged_by").agg(F.count("*").alias("n"), F.max("acknowledged_at").alias("last_acknowledged_at"))


@query(
    f"""{_STATES} SELECT date_trunc('day', ts) AS step, count(*) AS ingested, max(ts) AS evaluated_at, count(*) FILTER (WHERE previous_state = 'NONE' AND state <> 'NONE') AS created,
    count(*) FILTER (WHERE state <> 'NONE' AND previous_state <> 'NONE') AS updated, count(*) FILTER (WHERE previous_state <> 'NONE' AND state = 'NONE') AS cleared, count(DISTINCT point_id) AS points FROM states GROUP BY 1""",
    *_BASE,
)
def replay_step_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    was, now = F.col("previous_state") != "NONE", F.col("state") != "NONE"
    return (
        _states(spark, sf_dir)
        .groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("step"))
        .agg(
            F.count("*").alias("ingested"),
            F.max("ts").alias("evaluated_at"),
            F.count_if(~was & now).alias("created"),
            F.count_if(was & now).alias("updated"),
            F.count_if(was & ~now).alias("cleared"),
            F.countDistinct("point_id").alias("points"),
        )
    )


_RUN = f"""{_TICKS},
evals0 AS (SELECT r.rule_id, r.rule_type, r.operator, r.threshold_value, r.clear_value, r.enabled, r.severity, CASE WHEN day(a.tick) % 2 = 0 THEN r.delay_seconds ELSE r.delay_seconds * 12 END AS delay_seconds,
           a.point_id, a.value, a.quality, a.overridden, a.out_of_service, a.received_timestamp, a.stale_after_seconds, a.ingest_seq AS sample_seq, a.tick AS ts, 0 AS ingest_seq, a.tick AS eval_at
           FROM seen a JOIN alarm_rules r ON r.point_id = a.point_id),
evals1 AS (SELECT *, {_STATUS} AS status FROM evals0),
evals AS (SELECT *, {_CLEARS} AS clears FROM evals1),{_STATES.removeprefix(_EVALS + ",")}"""


def _run_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The replay as one plan: the values as of each tick, every rule evaluated on them at the tick, and the latch over the ticks. Delays change from day to day."""
    values = _as_of(spark, sf_dir).select("point_id", F.col("tick").alias("ts"), F.col("sample.ingest_seq").alias("sample_seq"), *(F.col(f"sample.{c}").alias(c) for c in ("value", "quality", "overridden", "out_of_service", "received_timestamp", "source_timestamp", "stale_after_seconds")))
    delay = F.when(F.dayofmonth("ts") % 2 == 0, F.col("delay_seconds")).otherwise(F.col("delay_seconds") * 12)
    evaluated = _evaluated(values.join(view(spark, sf_dir, "alarm_rules").drop("u"), "point_id"), F.col("ts")).withColumn("delay_seconds", delay)
    return lifecycle.alarm_states(evaluated.withColumn("seq", F.lit(0)))


@query(f"{_RUN} SELECT rule_id, ts, sample_seq, value, episode, CASE state WHEN 'PENDING' THEN 'PENDING_CREATED' WHEN 'ACTIVE' THEN 'ALARM_ACTIVATED' ELSE 'ALARM_CLEARED' END AS event_type FROM states WHERE state <> previous_state", "points", *_BASE)
def replay_run_all_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.transitions(_run_all(spark, sf_dir)).select("rule_id", "ts", "sample_seq", "value", "episode", "event_type")


@query(
    f"""{_RUN} SELECT ts AS tick, count(*) AS evaluated, count(*) FILTER (WHERE status = 'Triggered') AS triggered, count(*) FILTER (WHERE status = 'STALE') AS stale, count(*) FILTER (WHERE previous_state = 'NONE' AND state <> 'NONE') AS created,
    count(*) FILTER (WHERE state <> 'NONE' AND previous_state <> 'NONE') AS updated, count(*) FILTER (WHERE previous_state <> 'NONE' AND state = 'NONE') AS cleared FROM states GROUP BY ts""",
    "points",
    *_BASE,
)
def replay_run_all_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    was, now, status = F.col("previous_state") != "NONE", F.col("state") != "NONE", F.col("status")
    counts = {"triggered": status == "Triggered", "stale": status == "STALE", "created": ~was & now, "updated": was & now, "cleared": was & ~now}
    return _run_all(spark, sf_dir).groupBy(F.col("ts").alias("tick")).agg(F.count("*").alias("evaluated"), *(F.count_if(c).alias(n) for n, c in counts.items()))


# --- health -------------------------------------------------------------------------------

_CHANGES = """
q AS (SELECT point_id, ts, ingest_seq, value, CASE quality WHEN 'UNKNOWN' THEN 'UNCERTAIN' ELSE quality END AS quality, overridden, out_of_service FROM point_samples),
p AS (SELECT *, lag(quality) OVER w AS pq, lag(overridden) OVER w AS po, lag(out_of_service) OVER w AS ps FROM q WINDOW w AS (PARTITION BY point_id ORDER BY ingest_seq)),
b AS (SELECT *, CASE WHEN po THEN 'True' ELSE 'False' END AS pot, CASE WHEN overridden THEN 'True' ELSE 'False' END AS ot, CASE WHEN ps THEN 'True' ELSE 'False' END AS pst, CASE WHEN out_of_service THEN 'True' ELSE 'False' END AS st FROM p WHERE pq IS NOT NULL)"""


def _changes(spark: SparkSession, sf_dir: str, event: str) -> DataFrame:
    return projection.health_changes(view(spark, sf_dir, "point_samples")).where(F.col("event_type") == event)


def _change_sql(event: str, name: str, old: str, new: str) -> str:
    return f"{_CHANGES} SELECT point_id, ts, ingest_seq, value, '{event}' AS event_type, {old} AS previous_state, {new} AS new_state, concat('Point {name} changed from ', {old}, ' to ', {new}) AS message FROM b WHERE {old} <> {new}"


@query(_change_sql("POINT_QUALITY_CHANGED", "quality", "pq", "quality"), "point_samples")
def quality_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir, "POINT_QUALITY_CHANGED")


@query(_change_sql("POINT_OVERRIDE_CHANGED", "override", "pot", "ot"), "point_samples")
def override_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir, "POINT_OVERRIDE_CHANGED")


@query(_change_sql("POINT_OUT_OF_SERVICE_CHANGED", "out-of-service", "pst", "st"), "point_samples")
def oos_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir, "POINT_OUT_OF_SERVICE_CHANGED")


_STALE = f"{_TICKS}, stale AS (SELECT * FROM seen WHERE ingest_seq IS NOT NULL AND (quality = 'STALE' OR date_diff('microsecond', received_timestamp, tick) > {STALE_SECONDS * 1_000_000}))"


def _sweeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = _as_of(spark, sf_dir).where("sample is not null").select("tick", "sample.*")
    return ingest.stale_points(values, F.col("tick"))


@query(f"{_STALE} SELECT tick, point_id, ingest_seq FROM stale", "points", "point_samples")
def stale_points_at_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sweeps(spark, sf_dir).select("tick", "point_id", "ingest_seq")


@query(f"{_STALE} SELECT point_id, ingest_seq, min(tick) AS tick, count(*) AS sweeps FROM stale GROUP BY ALL", "points", "point_samples")
def stale_events_deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.first_stale(_sweeps(spark, sf_dir))


@query(f"{_STALE}, f AS (SELECT point_id, ingest_seq, min(tick) AS tick FROM stale GROUP BY ALL) SELECT a.tick, count(*) AS checked, count(s.point_id) AS stale, count(f.point_id) AS new_events FROM seen a LEFT JOIN stale s USING (tick, point_id) LEFT JOIN f ON f.point_id = a.point_id AND f.tick = a.tick AND f.ingest_seq = a.ingest_seq WHERE a.ingest_seq IS NOT NULL GROUP BY a.tick", "points", "point_samples")
def health_sweep_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.sweep_counters(_as_of(spark, sf_dir).where("sample is not null").select("tick", "sample.*"))


# --- log and context ----------------------------------------------------------------------


@query("SELECT severity, source, equipment, count(*) AS n FROM alarm_log GROUP BY GROUPING SETS ((severity), (source), (equipment), ())", "alarm_log")
def log_counts_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = view(spark, sf_dir, "alarm_log")
    keys = [F.col(c) for c in ("severity", "source", "equipment")]
    return log.groupingSets([[keys[0]], [keys[1]], [keys[2]], []], *keys).agg(F.count("*").alias("n"))


@query("SELECT * FROM alarm_log WHERE severity = '1-URGENT' AND status = 'O'", "alarm_log")
def log_active_critical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "alarm_log").where("severity = '1-URGENT' and status = 'O'").orderBy("ts", "equipment", "l_orderkey", "l_linenumber")


@query(
    f"SELECT a.*, CAST(CASE status WHEN 'Open' THEN 0 WHEN 'In Progress' THEN 1 ELSE 2 END AS INTEGER) AS status_rank, {_EQ.format(d='')} FROM corrective_actions a LEFT JOIN equipment e ON a.equipment_id = e.equipment",
    "corrective_actions",
    "equipment",
)
def actions_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = readmodels.actions_ranked(view(spark, sf_dir, "corrective_actions"), view(spark, sf_dir, "equipment"))
    return out.withColumn("status_rank", readmodels.ranked("status", "Open", "In Progress", "Complete"))


@query(
    """i AS (SELECT id, trim(unnest(string_split(steps, ';'))) AS item, generate_subscripts(string_split(steps, ';'), 1) AS n FROM corrective_actions)
SELECT id, CAST(count(*) AS INTEGER) AS items, string_agg(item, '|' ORDER BY n) AS joined FROM i WHERE item <> '' GROUP BY id""",
    "corrective_actions",
)
def semicolon_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = t.semicolon_list(F.col("steps"))
    return view(spark, sf_dir, "corrective_actions").select("id", F.size(items).alias("items"), F.array_join(items, "|").alias("joined"))


@query(
    "SELECT p.point_id, CAST(count(r.rule_id) AS INTEGER) AS members, coalesce(string_agg(r.rule_id, ',' ORDER BY r.rule_id), '') AS member_ids FROM points p LEFT JOIN alarm_rules r ON r.point_id = p.point_id AND r.severity = 'Critical' GROUP BY p.point_id",
    "points",
    "alarm_rules",
)
def correlation_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = view(spark, sf_dir, "alarm_rules").where("severity = 'Critical'").select("point_id", "rule_id", "severity")
    out = readmodels.nested(view(spark, sf_dir, "points").select("point_id"), rules, "point_id", "rule_id")
    return out.select("point_id", F.size("members").alias("members"), F.array_join("members.rule_id", ",").alias("member_ids"))


# --- ingest, scenarios and catalog changes --------------------------------------------------


#: Samples as text, some of them spoilt, and what the ingest says of them: quality, source, then the point.
_SPOILT = """s AS (SELECT * REPLACE (CASE WHEN ingest_seq % 23 = 0 THEN 'PT-none' ELSE point_id END AS point_id, CASE WHEN ingest_seq % 29 = 0 THEN 'n/a' WHEN ingest_seq % 47 = 0 THEN '' ELSE value END AS value), CAST(hour(ts) AS VARCHAR) AS sequence FROM point_samples),
c AS (SELECT s.*, p.unit, CASE WHEN ingest_seq % 31 = 0 THEN 'quality must be one of: BAD, GOOD, STALE, UNCERTAIN, UNKNOWN' WHEN ingest_seq % 37 = 0 THEN 'source must be one of: BMS, DCIM, EPMS, MANUAL, PLC, SCENARIO, SIMULATED'
        WHEN p.point_id IS NULL THEN 'Point not found: ' || s.point_id END AS error FROM s LEFT JOIN points p ON s.point_id = p.point_id)"""


@query(f"{_SPOILT} SELECT ingest_seq, coalesce(error, '') AS error FROM c", "points", "point_samples")
def ingest_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir).select("ingest_seq", F.coalesce("error", F.lit("")).alias("error"))


def raw_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All samples as text, some of them spoilt."""
    seq = F.col("ingest_seq")
    odd = lambda n, c, bad: F.when(seq % n == 0, F.lit(bad)).otherwise(F.col(c)).alias(c)
    return view(spark, sf_dir, "point_samples").select(
        "ingest_seq",
        odd(23, "point_id", "PT-none"),
        F.when(seq % 29 == 0, " n/a ").when(seq % 47 == 0, " ").otherwise(F.col("value")).alias("value"),
        odd(31, "quality", "ODD"),
        odd(37, "source", "FAX"),
        F.lit("").alias("unit"),
        F.col("stale_after_seconds").cast("string").alias("stale_after_seconds"),
        F.col("overridden").cast("string").alias("overridden"),
        F.col("out_of_service").cast("string").alias("out_of_service"),
        F.when(seq % 41 == 0, "soon").when(seq % 43 == 0, " ").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("source_timestamp"),
        F.concat(F.lit(" slot "), seq % 5).alias("address"),
        F.when(seq % 3 == 0, " night ").alias("created_by"),
    )


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.checked_samples(raw_samples(spark, sf_dir), view(spark, sf_dir, "points"), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))


_WHAT_IF = """updates AS (SELECT CAST(u % 8 AS VARCHAR) AS scenario_id, u AS position, CASE WHEN u % 40 = 17 THEN 'PT-none' ELSE point_id END AS point_id, '99' AS value FROM points WHERE u % 3 = 0),
refused AS (SELECT w.scenario_id, min(w.position) AS position FROM updates w LEFT JOIN points p ON w.point_id = p.point_id WHERE p.point_id IS NULL GROUP BY ALL)"""


def _what_if(points: DataFrame) -> DataFrame:
    """Eight scenarios over a third of the points; some name a point that is not there."""
    u = F.col("u")
    return points.where(u % 3 == 0).select((u % 8).cast("string").alias("scenario_id"), u.alias("position"), F.when(u % 40 == 17, "PT-none").otherwise(F.col("point_id")).alias("point_id"), F.lit("99").alias("value"))


@query(
    f"""latest AS (SELECT * FROM point_samples QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY ingest_seq DESC) = 1), {_WHAT_IF},
hits AS (SELECT DISTINCT point_id FROM updates WHERE scenario_id NOT IN (SELECT scenario_id FROM refused)),
old AS (SELECT * FROM latest WHERE substr(point_id, 4) NOT LIKE '%5'),
s AS (SELECT point_id, value, quality, overridden, out_of_service, received_timestamp, stale_after_seconds, false AS from_scenario FROM old WHERE point_id NOT IN (SELECT point_id FROM hits)
      UNION ALL SELECT point_id, '99', 'GOOD', false, false, TIMESTAMP '2024-02-01 00:00:00', 300, true FROM hits),
e0 AS (SELECT r.rule_id, r.rule_type, r.operator, r.threshold_value, r.enabled, s.*, TIMESTAMP '2024-02-01 00:00:00' AS eval_at FROM alarm_rules r JOIN s ON r.point_id = s.point_id),
e1 AS (SELECT *, {_STATUS} AS status FROM e0)
SELECT rule_id, from_scenario, status FROM e1""",
    "points",
    *_BASE,
)
def scenario_what_if(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenarios that can be applied as a whole, over current values that some points lack."""
    points, at = view(spark, sf_dir, "points"), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    current = projection.latest(view(spark, sf_dir, "point_samples")).where(~F.col("point_id").endswith("5"))
    now = ingest.with_scenarios(current, _what_if(points), points, at)
    out = _evaluated(now.join(view(spark, sf_dir, "alarm_rules"), "point_id"), at)
    return out.select("rule_id", "from_scenario", "status")


@query(f"{_WHAT_IF} SELECT scenario_id, 'Point not found: PT-none' AS error FROM refused", "points")
def scenario_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = view(spark, sf_dir, "points")
    return ingest.refusals(_what_if(points), points)


_UPDATES = "SELECT rule_id, CASE WHEN u % 3 = 0 THEN '75' END AS threshold_value, CASE WHEN u % 2 = 0 THEN 'Warning' END AS severity, CASE WHEN u % 5 = 0 THEN 60 END AS delay_seconds FROM alarm_rules"


def _updates(rules: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return rules.select(
        "rule_id",
        F.when(F.col("u") % 3 == 0, "75").alias("threshold_value"),
        none.alias("clear_value"),
        F.when(F.col("u") % 2 == 0, "Warning").alias("severity"),
        none.alias("alarm_message"),
        none.alias("enabled"),
        F.when(F.col("u") % 5 == 0, 60).alias("delay_seconds"),
    )


@query(
    f"""n AS ({_UPDATES}), c AS (
SELECT r.rule_id, 'threshold_value' AS field, r.threshold_value AS old_value, n.threshold_value AS new_value FROM alarm_rules r JOIN n USING (rule_id)
UNION ALL SELECT r.rule_id, 'severity', r.severity, n.severity FROM alarm_rules r JOIN n USING (rule_id)
UNION ALL SELECT r.rule_id, 'delay_seconds', CAST(r.delay_seconds AS VARCHAR), CAST(n.delay_seconds AS VARCHAR) FROM alarm_rules r JOIN n USING (rule_id))
SELECT * FROM c WHERE new_value IS NOT NULL AND new_value <> old_value""",
    "alarm_rules",
)
def rule_update_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = view(spark, sf_dir, "alarm_rules")
    return catalog.rule_changes(rules, _updates(rules))


@query(
    """q AS (SELECT CASE WHEN u % 4 = 0 THEN rule_id ELSE concat('NEW-', rule_id) END AS rule_id, CASE WHEN u % 7 = 0 THEN 'PT-none' ELSE point_id END AS point_id, CASE WHEN u % 9 = 0 THEN ' ' ELSE rule_name END AS rule_name,
       CASE WHEN u % 17 = 0 THEN 'none' ELSE alarm_message END AS alarm_message, CASE WHEN u % 19 = 0 THEN 'fuzzy' ELSE rule_type END AS rule_type, CASE WHEN u % 6 = 0 THEN '' ELSE threshold_value END AS threshold_value,
       CASE WHEN u % 10 = 0 THEN '~' ELSE operator END AS operator, CASE WHEN u % 13 = 0 THEN 'Loud' ELSE severity END AS severity, CASE WHEN u % 23 = 0 THEN 'on' WHEN u % 21 = 0 THEN NULL ELSE 'yes' END AS enabled, CASE WHEN u % 29 = 0 THEN '-1' ELSE '5' END AS delay_seconds, u FROM alarm_rules),
m AS (SELECT *, concat_ws(', ', CASE WHEN trim(rule_name) = '' THEN 'rule_name' END, CASE WHEN alarm_message = 'none' THEN 'alarm_message' END, CASE WHEN enabled IS NULL THEN 'enabled' END) AS missing FROM q)
SELECT rule_id, u, CASE WHEN missing <> '' THEN concat('Missing required alarm rule field(s): ', missing)
   WHEN rule_type = 'fuzzy' THEN 'rule_type must be one of: analog_limit, boolean_state, enum_match'
   WHEN operator = '~' THEN concat('operator for ', rule_type, ' must be one of: ', CASE rule_type WHEN 'analog_limit' THEN '<, <=, >, >=' ELSE '!=, ==' END)
   WHEN severity = 'Loud' THEN 'severity must be one of: Critical, Info, Warning' WHEN enabled = 'on' THEN 'enabled must be one of: 1, 0, true, false, yes, no'
   WHEN delay_seconds = '-1' THEN 'delay_seconds must be a non-negative integer' WHEN u % 4 = 0 THEN concat('Alarm rule already exists: ', rule_id) WHEN u % 7 = 0 THEN concat('Point not found: ', point_id) ELSE '' END AS error FROM m""",
    "alarm_rules",
)
def rule_create_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules, u = view(spark, sf_dir, "alarm_rules"), F.col("u")
    requests = rules.withColumns(
        {
            "rule_id": F.when(u % 4 == 0, F.col("rule_id")).otherwise(F.concat(F.lit("NEW-"), "rule_id")),
            "point_id": F.when(u % 7 == 0, "PT-none").otherwise(F.col("point_id")),
            "rule_name": F.when(u % 9 == 0, " ").otherwise(F.col("rule_name")),
            "alarm_message": F.when(u % 17 == 0, "none").otherwise(F.col("alarm_message")),
            "rule_type": F.when(u % 19 == 0, "fuzzy").otherwise(F.col("rule_type")),
            "threshold_value": F.when(u % 6 == 0, "").otherwise(F.col("threshold_value")),
            "operator": F.when(u % 10 == 0, "~").otherwise(F.col("operator")),
            "severity": F.when(u % 13 == 0, "Loud").otherwise(F.col("severity")),
            "enabled": F.when(u % 23 == 0, "on").when(u % 21 == 0, F.lit(None)).otherwise("yes"),
            "delay_seconds": F.when(u % 29 == 0, "-1").otherwise("5"),
        }
    )
    out = catalog.checked_rules(requests, rules, view(spark, sf_dir, "points"))
    return out.select("rule_id", "u", F.coalesce("error", F.lit("")).alias("error"))


# --- register-map import ------------------------------------------------------------------

_ROWS = r"""
n0 AS (SELECT row_number, CASE WHEN lower(trim(scale)) IN ('n/a') THEN NULL ELSE try_cast(scale AS DOUBLE) END AS scale_n, lower(trim(scale)) = 'n/a' AS scale_missing,
       regexp_replace(regexp_replace(regexp_replace(replace(upper(trim(device_name)), ' ', '-'), '[^A-Z0-9_-]+', '-', 'g'), '-+', '-', 'g'), '^[-_]+|[-_]+$', '', 'g') AS equipment_id,
       regexp_replace(regexp_replace(upper(trim(point_name)), '[^A-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS point_name,
       CAST(slave_id AS BIGINT) AS s, CAST(function_code AS BIGINT) AS f, CAST(register_address AS BIGINT) AS r, lower(data_type) AS dt FROM register_map),
n1 AS (SELECT *, s BETWEEN 1 AND 247 AS s_ok, f BETWEEN 1 AND 4 AS f_ok, r BETWEEN 0 AND 65535 AS r_ok, dt <> 'text' AS d_ok, concat(equipment_id, '_', point_name) AS point_id FROM n0),
n2 AS (SELECT *, s_ok AND f_ok AND r_ok AND d_ok AND scale_n IS NOT NULL AS complete, concat('slave_id=', s, ';function_code=', f, ';register_address=', r) AS address,
       CAST(NOT s_ok AS INTEGER) + CAST(NOT f_ok AS INTEGER) + CAST(NOT r_ok AS INTEGER) + CAST(NOT d_ok AS INTEGER) + CAST(scale_n IS NULL AS INTEGER) AS issues FROM n1),
d AS (SELECT *, min(row_number) OVER (PARTITION BY point_id) AS fp, min(row_number) OVER (PARTITION BY address) AS fa FROM n2 WHERE complete),
dups AS (SELECT row_number, point_id, address, 'point_name' AS field, fp AS first_row, concat('Duplicate point_name in import: ', point_name, ' also appears on row ', fp) AS message FROM d WHERE row_number > fp
  UNION ALL SELECT row_number, point_id, address, 'register_address', fa, concat('Duplicate Modbus address tuple in import: slave_id=', s, ', function_code=', f, ', register_address=', r, ' also appears on row ', fa) FROM d WHERE row_number > fa),
own AS (SELECT protocol, address, max(point_id) AS owner FROM points WHERE protocol <> '' AND address <> '' GROUP BY ALL),
k AS (SELECT c.row_number, c.point_id, c.equipment_id, c.address, p.point_id IS NOT NULL AS found, coalesce(p.protocol, '') AS kp, coalesce(p.address, '') AS ka, CASE WHEN own.owner <> c.point_id THEN own.owner END AS address_owner
      FROM n2 c LEFT JOIN points p ON c.point_id = p.point_id LEFT JOIN own ON own.protocol = 'modbus' AND own.address = c.address WHERE c.complete),
conf AS (SELECT *, CASE WHEN NOT found THEN 'create_point' WHEN kp = '' OR ka = '' THEN 'update_point_metadata' WHEN kp = 'modbus' AND ka = address THEN 'skip_existing_point' ELSE 'create_point' END AS action,
         found AND kp <> '' AND ka <> '' AND NOT (kp = 'modbus' AND ka = address) AS metadata_conflict FROM k)"""
_IMPORT = ("points", "equipment", "register_map")


def _import(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importer.normalised(view(spark, sf_dir, "register_map"))


@query(f"{_ROWS} SELECT row_number, equipment_id, point_name, point_id, complete, CAST(issues AS INTEGER) AS issues FROM n2", *_IMPORT)
def import_preview_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _import(spark, sf_dir)
    return rows.select("row_number", "equipment_id", "point_name", "point_id", "complete", F.size("issues").alias("issues"))


@query(
    f"""{_ROWS} SELECT field, count(*) AS n FROM (SELECT unnest([CASE WHEN NOT s_ok THEN 'slave_id' END, CASE WHEN NOT f_ok THEN 'function_code' END, CASE WHEN NOT r_ok THEN 'register_address' END, CASE WHEN NOT d_ok THEN 'data_type' END, CASE WHEN scale_n IS NULL THEN 'scale' END]) AS field FROM n2) WHERE field IS NOT NULL GROUP BY field""",
    *_IMPORT,
)
def import_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _import(spark, sf_dir)
    return rows.select(F.explode("issues.field").alias("field")).groupBy("field").agg(F.count("*").alias("n"))


@query(f"{_ROWS} SELECT * FROM dups", *_IMPORT)
def import_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _import(spark, sf_dir)
    return importer.duplicate_issues(rows)


@query(f"{_ROWS} SELECT row_number, point_id, action, address_owner, metadata_conflict FROM conf", *_IMPORT)
def import_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _import(spark, sf_dir)
    return importer.with_conflicts(rows, view(spark, sf_dir, "points")).select("row_number", "point_id", "action", "address_owner", "metadata_conflict")


@query(
    f"""{_ROWS}, errs AS (SELECT row_number FROM n2, LATERAL (SELECT unnest(range(issues))) i UNION ALL SELECT row_number FROM dups UNION ALL SELECT row_number FROM conf WHERE address_owner IS NOT NULL UNION ALL SELECT row_number FROM conf WHERE metadata_conflict)
SELECT (SELECT count(*) FROM n2) AS total_rows, (SELECT count(*) FROM errs) AS error_count, (SELECT count(DISTINCT equipment_id) FROM n2 WHERE complete AND equipment_id NOT IN (SELECT equipment FROM equipment)) AS would_create_equipment_count,
 (SELECT count(*) FROM conf) AS parsed_rows, (SELECT count(*) FILTER (WHERE found AND NOT metadata_conflict) FROM conf) AS warning_count, (SELECT count(*) FILTER (WHERE action = 'create_point') FROM conf) AS would_create_point_count,
 (SELECT count(*) FILTER (WHERE action = 'update_point_metadata') FROM conf) AS would_update_point_count, (SELECT count(*) FILTER (WHERE action = 'skip_existing_point') FROM conf) AS would_skip_point_count,
 greatest((SELECT count(*) FROM n2) - (SELECT count(DISTINCT row_number) FROM errs), 0) AS valid_rows""",
    *_IMPORT,
)
def import_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _import(spark, sf_dir)
    return importer.preview_summary(rows, view(spark, sf_dir, "points"), view(spark, sf_dir, "equipment"))


@query(f"{_ROWS}, errs AS (SELECT row_number FROM n2 WHERE issues > 0 UNION ALL SELECT row_number FROM dups UNION ALL SELECT row_number FROM conf WHERE address_owner IS NOT NULL OR metadata_conflict) SELECT row_number, point_id, equipment_id, address FROM conf WHERE action = 'create_point' AND row_number NOT IN (SELECT row_number FROM errs)", *_IMPORT)
def import_committed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the commit of a file of the error-free rows would add."""
    points, equipment = view(spark, sf_dir, "points").withColumn("description", F.lit("")).withColumn("source_system", F.lit("")), view(spark, sf_dir, "equipment")
    rows = importer.without_errors(_import(spark, sf_dir), points, equipment)
    _, created, _ = importer.committed(rows, points, equipment, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))
    return created.join(rows.select("point_id", "row_number"), "point_id").select("row_number", "point_id", "equipment_id", "address")


@query(
    rf"""{_ROWS}, i AS (SELECT row_number, equipment_id, point_name, d.kind AS data_type,
  CASE WHEN equipment_id LIKE 'UPS%' THEN 'UPS' WHEN equipment_id LIKE 'GEN%' THEN 'Generator' WHEN equipment_id LIKE 'CRAH%' THEN 'CRAH' WHEN equipment_id LIKE 'MTR%' THEN 'Electrical Meter' ELSE 'Modbus Device' END AS equipment_type,
  array_to_string(list_transform(string_split(point_name, '_'), lambda x: concat(upper(x[1]), lower(x[2:]))), ' ') AS words
  FROM n2 LEFT JOIN (VALUES ('bool', 'boolean'), ('float32', 'analog'), ('enum', 'enum'), ('uint16', 'analog')) AS d(dt, kind) ON n2.dt = d.dt)
SELECT row_number, equipment_type, data_type, CASE WHEN equipment_type IN ('UPS', 'Generator', 'Electrical Meter') THEN 'EPMS' ELSE 'BMS' END AS source_system,
  CASE WHEN equipment_type IN ('UPS', 'Generator', 'Electrical Meter') THEN 'Critical' WHEN equipment_type = 'CRAH' THEN 'High' ELSE 'Medium' END AS criticality,
  CASE WHEN equipment_type IN ('UPS', 'Electrical Meter') THEN 'Electrical Room A' WHEN equipment_type = 'Generator' THEN 'Generator Yard' WHEN equipment_type = 'CRAH' THEN 'Data Hall A' ELSE 'Local Simulation' END AS location,
  concat(equipment_id, ' ', words) AS display_name, CASE WHEN data_type = 'boolean' THEN 'status' ELSE 'sensor' END AS point_type FROM i""",
    *_IMPORT,
)
def import_inferred_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _import(spark, sf_dir).select("row_number", "equipment_type", "data_type", "source_system", "criticality", "location", "display_name", "point_type")


# --- enriched reads, audit events and the replay's own counts -------------------------------


@query(
    f"""latest AS (SELECT *, concat('PS-', point_id, '-', substr(sha256(concat_ws('|', point_id, CAST(ingest_seq AS VARCHAR))), 1, 12)) AS latest_sample_id FROM point_samples QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY ingest_seq DESC) = 1),
e0 AS (SELECT r.*, s.* EXCLUDE (point_id), p.point_name, p.display_name, p.equipment_id, p.data_type, p.unit, p.protocol, p.address, coalesce(e.equipment_type, 'Unknown') AS equipment_type, coalesce(e.location, 'Unknown') AS location, (SELECT max(ts) FROM point_samples) AS eval_at
       FROM alarm_rules r LEFT JOIN points p ON r.point_id = p.point_id LEFT JOIN equipment e ON p.equipment_id = e.equipment LEFT JOIN latest s ON r.point_id = s.point_id AND s.point_id NOT LIKE '%7'),
e1 AS (SELECT *, {_STATUS} AS status FROM e0)
SELECT rule_id AS id, rule_name, rule_type, enabled, severity, alarm_message, equipment_id, equipment_type, location, point_id, point_name, display_name, data_type, unit, latest_sample_id, value AS current_value, quality, source, source_timestamp, received_timestamp,
       stale_after_seconds, coalesce(overridden, false) AS overridden, coalesce(out_of_service, false) AS out_of_service, CASE WHEN latest_sample_id IS NOT NULL THEN 'SIMULATED' END AS protocol, CASE WHEN latest_sample_id IS NOT NULL THEN '' END AS address,
       operator, threshold_value, clear_value, delay_seconds, status = 'Triggered' AS is_triggered, status AS evaluation_status,
       CAST(row_number() OVER (ORDER BY equipment_id NULLS FIRST, point_name NULLS FIRST, rule_name, rule_id) AS BIGINT) AS place FROM e1""",
    "points",
    "equipment",
    *_BASE,
)
def rule_evaluations_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole catalog at one time, with all that a reader sees, and the place of each rule in the order; every tenth point has no value."""
    samples = view(spark, sf_dir, "point_samples")
    at = samples.agg(F.max("ts").alias("at"))  # one row
    current = projection.latest(samples).where(~F.col("point_id").endswith("7")).select("*", sample_id(F.col("point_id"), F.col("ingest_seq")).alias("sample_id"), F.lit("SIMULATED").alias("protocol"), F.lit("").alias("address"))
    rules = view(spark, sf_dir, "alarm_rules").drop("u").join(current, "point_id", "left").crossJoin(F.broadcast(at))
    out = readmodels.evaluations_enriched(_evaluated(rules, F.col("at")), view(spark, sf_dir, "points"), view(spark, sf_dir, "equipment"))
    return readmodels.numbered(out, "equipment_id", "point_name", "rule_name", "id")


@query(
    """latest AS (SELECT * FROM point_samples QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY ingest_seq DESC) = 1), m AS (SELECT max(ts) AS eval_at FROM point_samples)
SELECT s.point_id, p.point_name, p.equipment_id, p.unit, CASE WHEN overridden THEN 'OVERRIDDEN' WHEN out_of_service THEN 'OUT_OF_SERVICE' WHEN quality = 'BAD' THEN 'BAD_QUALITY' WHEN quality = 'STALE' THEN 'STALE' WHEN quality <> 'GOOD' THEN 'UNCERTAIN_QUALITY'
       WHEN date_diff('microsecond', received_timestamp, eval_at) > stale_after_seconds * 1000000 THEN 'STALE' ELSE 'ELIGIBLE' END AS health FROM latest s CROSS JOIN m LEFT JOIN points p ON s.point_id = p.point_id""",
    "points",
    "point_samples",
)
def point_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = view(spark, sf_dir, "point_samples")
    at = samples.agg(F.max("ts").alias("at"))  # one row
    stale = r.is_stale(F.col("received_timestamp"), F.col("source_timestamp"), F.col("stale_after_seconds"), F.col("at"))
    health = r.eligibility(F.col("quality"), F.col("overridden"), F.col("out_of_service"), stale)
    now = projection.latest(samples).crossJoin(F.broadcast(at)).select("point_id", health.alias("health"))
    return now.join(view(spark, sf_dir, "points").select("point_id", "point_name", "equipment_id", "unit"), "point_id", "left")


@query("SELECT point_id, point_name, equipment_id FROM points WHERE point_id IN (SELECT point_id FROM point_samples WHERE quality = 'BAD' AND overridden)", "points", "point_samples")
def points_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = view(spark, sf_dir, "point_samples").where("quality = 'BAD' and overridden").select("point_id")
    return view(spark, sf_dir, "points").select("point_id", "point_name", "equipment_id").join(wanted, "point_id", "left_semi")


_SCENARIO = "SELECT CASE WHEN u % 9 = 0 THEN concat('PT-none-', CAST(u AS {string})) ELSE point_id END AS point_id, CAST(u % 100 AS {string}) AS value FROM {points} WHERE u % 3 = 0"


@query(
    f"""w AS ({_SCENARIO.format(string="VARCHAR", points="points")})
SELECT w.point_id, w.value, coalesce(p.point_name, w.point_id) AS point_name, coalesce(p.equipment_id, '') AS equipment_id, coalesce(p.unit, '') AS unit, p.point_id IS NOT NULL AS known FROM w LEFT JOIN points p ON w.point_id = p.point_id""",
    "points",
)
def scenario_point_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = view(spark, sf_dir, "points")
    updates = spark.sql(_SCENARIO.format(string="STRING", points="{points}"), points=points)
    return readmodels.scenario_points(updates, points)


@query(
    f"""{_ALARMS} SELECT a.rule_id, a.episode, a.state, a.created_at, r.rule_name, r.point_id, p.point_name, p.display_name, p.equipment_id, {_EQ.format(d="Unknown")}
FROM alarms a LEFT JOIN alarm_rules r USING (rule_id) LEFT JOIN points p ON r.point_id = p.point_id LEFT JOIN equipment e ON p.equipment_id = e.equipment""",
    "points",
    "equipment",
    *_BASE,
)
def generated_alarms_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules, points = view(spark, sf_dir, "alarm_rules"), view(spark, sf_dir, "points")
    out = readmodels.generated_alarms(_alarms(spark, sf_dir), rules, points, view(spark, sf_dir, "equipment"))
    return out.select("rule_id", "episode", "state", "created_at", "rule_name", "point_id", "point_name", "display_name", "equipment_id", "equipment_type", "location", "criticality", "equipment_source_system")


@query(f"{_ALARMS} SELECT rule_id, episode, state FROM alarms WHERE state <> 'CLEARED' QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY CASE state WHEN 'ACTIVE' THEN 0 ELSE 1 END, last_evaluated_at DESC) = 1", *_BASE)
def first_open_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.first_open(lifecycle.episodes(_states(spark, sf_dir)))


@query(f"{_ALARMS} SELECT rule_id, episode, 'CLEARED' AS state, 'Rule not evaluated' AS evaluation_note FROM alarms JOIN alarm_rules USING (rule_id) WHERE state <> 'CLEARED' AND u % 7 = 0", *_BASE)
def orphaned_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = view(spark, sf_dir, "alarm_rules").where("u % 7 <> 0")
    return lifecycle.orphaned(lifecycle.episodes(_states(spark, sf_dir)), left).select("rule_id", "episode", "state", "evaluation_note")


def _commands(alarms: DataFrame) -> DataFrame:
    """One command an hour after the start of every second alarm, and another a day later on every fourth."""
    first = alarms.where("episode % 2 = 0").select("rule_id", "episode", F.expr("created_at + INTERVAL 1 HOUR").alias("acknowledged_at"), F.when(F.col("episode") % 4 == 0, " night shift ").otherwise(" n/a ").alias("operator"))
    again = alarms.where("episode % 4 = 0").select("rule_id", "episode", F.expr("created_at + INTERVAL 1 DAY").alias("acknowledged_at"), F.lit("day shift").alias("operator"))
    return first.unionByName(again)


def _acknowledged(spark: SparkSession, sf_dir: str) -> DataFrame:
    alarms = lifecycle.episodes(_states(spark, sf_dir))
    return lifecycle.acknowledge(alarms, _commands(alarms))


_ACKS = f"""{_ALARMS}, commands AS (SELECT rule_id, episode, created_at + INTERVAL 1 HOUR AS acknowledged_at, CASE WHEN episode % 4 = 0 THEN 'night shift' ELSE 'local-operator' END AS operator FROM alarms WHERE episode % 2 = 0
  UNION ALL SELECT rule_id, episode, created_at + INTERVAL 1 DAY, 'day shift' FROM alarms WHERE episode % 4 = 0),
k AS (SELECT a.*, c.operator IS NOT NULL AS acknowledged, c.acknowledged_at, coalesce(c.operator, '') AS operator FROM alarms a LEFT JOIN (SELECT * FROM commands QUALIFY row_number() OVER (PARTITION BY rule_id, episode ORDER BY acknowledged_at DESC) = 1) c USING (rule_id, episode))"""


@query(f"{_ACKS} SELECT rule_id, episode, state, acknowledged, acknowledged_at, operator AS acknowledged_by FROM k", *_BASE)
def acknowledged_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _acknowledged(spark, sf_dir).select("rule_id", "episode", "state", "acknowledged", "acknowledged_at", "acknowledged_by")


@query(
    f"""{_ACKS} SELECT count(*) FILTER (WHERE k.state = 'ACTIVE' AND acknowledged) AS active_acknowledged, count(*) FILTER (WHERE k.state = 'ACTIVE' AND NOT acknowledged) AS active_unacknowledged,
    count(*) FILTER (WHERE k.state = 'ACTIVE' AND severity = 'Critical') AS active_critical, count(*) FILTER (WHERE k.state = 'ACTIVE' AND severity = 'Warning') AS active_warning, count(*) FILTER (WHERE k.state = 'ACTIVE' AND severity = 'Info') AS active_info FROM k JOIN alarm_rules USING (rule_id)""",
    *_BASE,
)
def acknowledged_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _acknowledged(spark, sf_dir).join(view(spark, sf_dir, "alarm_rules").select("rule_id", "severity"), "rule_id")
    active = F.col("state") == "ACTIVE"
    kinds = {"acknowledged": F.col("acknowledged"), "unacknowledged": ~F.col("acknowledged"), **{s.lower(): F.col("severity") == s for s in t.SEVERITIES}}
    return out.agg(*(F.count_if(active & c).alias(f"active_{n}") for n, c in kinds.items()))


@query(
    """q AS (SELECT *, CASE WHEN u % 6 = 0 THEN 'tags, zone' WHEN u % 6 = 1 THEN 'tags' ELSE '' END AS extra FROM alarm_rules)
SELECT rule_id, CASE WHEN extra <> '' THEN concat('Unsupported alarm rule field(s): ', extra) WHEN u % 4 = 0 THEN concat('Alarm rule already exists: ', rule_id) ELSE '' END AS error FROM q""",
    "alarm_rules",
)
def rule_create_unsupported_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = view(spark, sf_dir, "alarm_rules")
    extra = F.when(F.col("u") % 6 == 0, F.array(F.lit("zone"), F.lit("tags"))).when(F.col("u") % 6 == 1, F.array(F.lit("tags")))
    out = catalog.checked_rules(rules.withColumn("extra", extra), rules.where("u % 4 = 0"), view(spark, sf_dir, "points"), "extra")
    return out.select("rule_id", F.coalesce("error", F.lit("")).alias("error"))


def _replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checked samples, each with the step of the replay that it belongs to: the hour of its day."""
    steps = view(spark, sf_dir, "point_samples").select("ingest_seq", F.hour("ts").cast("string").alias("sequence"))
    return _checked(spark, sf_dir).join(steps, "ingest_seq")


@query(
    f"""{_SPOILT} SELECT ingest_seq, concat('PS-', c.point_id, '-', substr(sha256(concat_ws('|', c.point_id, CAST(ingest_seq AS VARCHAR))), 1, 12)) AS sample_id, c.point_id, c.value, unit, CASE quality WHEN 'UNKNOWN' THEN 'UNCERTAIN' ELSE quality END AS quality,
       CASE WHEN ingest_seq % 41 = 0 THEN NULL WHEN ingest_seq % 43 = 0 THEN TIMESTAMP '2024-02-01 00:00:00' ELSE CAST(date_trunc('second', ts) AS TIMESTAMP) END AS source_timestamp, TIMESTAMP '2024-02-01 00:00:00' AS received_timestamp, source,
       'SIMULATED' AS protocol, concat('slot ', ingest_seq % 5) AS address, stale_after_seconds, overridden, out_of_service, CASE WHEN ingest_seq % 3 = 0 THEN 'night' ELSE 'simulated-driver' END AS created_by FROM c WHERE error IS NULL""",
    "points",
    "point_samples",
)
def ingest_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = ingest.split_checked(_checked(spark, sf_dir))
    return good


@query(f'{_SPOILT} SELECT sequence, ingest_seq AS "index", point_id, error FROM c WHERE error IS NOT NULL', "points", "point_samples")
def replay_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.in_replay_order(_replayed(spark, sf_dir).where("error is not null").withColumn("row_number", F.col("ingest_seq"))).select("sequence", F.col("ingest_seq").alias("index"), "point_id", "error")


@query(f"{_SPOILT} SELECT sequence, count(*) FILTER (WHERE error IS NULL) AS ingested, count(*) FILTER (WHERE error IS NOT NULL) AS failed FROM c GROUP BY ROLLUP (sequence)", "points", "point_samples")
def replay_ingest_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.step_counters(_replayed(spark, sf_dir), "sequence")


@query("SELECT DISTINCT CAST(hour(ts) AS VARCHAR) AS sequence FROM point_samples", "point_samples")
def replay_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.replay_sequences(view(spark, sf_dir, "point_samples").select(F.hour("ts").cast("string").alias("sequence")))


@query(f"{_SPOILT} SELECT sequence, coalesce(string_agg(DISTINCT point_id, ',' ORDER BY point_id) FILTER (error IS NULL), '') AS points_updated FROM c GROUP BY sequence", "points", "point_samples")
def replay_updated_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.updated_points(_replayed(spark, sf_dir), "sequence").select("sequence", F.array_join("points_updated", ",").alias("points_updated"))


@query(
    f"""{_EVENTS}, a AS (SELECT rule_id, episode, state AS alarm_state FROM alarms) SELECT t.rule_id, t.episode, t.ts, t.event_type, coalesce(a.alarm_state, '') AS alarm_state, coalesce(r.rule_name, '') AS rule_name FROM transitions t LEFT JOIN a ON t.rule_id = a.rule_id AND t.episode = a.episode LEFT JOIN alarm_rules r ON t.rule_id = r.rule_id""".replace("transitions AS (", _ALARMS.removeprefix(_STATES + ",").strip() + ",\ntransitions AS (", 1),
    *_BASE,
)
def alarm_events_with_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = _states(spark, sf_dir)
    alarms = lifecycle.episodes(states).select("rule_id", "episode", F.col("state").alias("alarm_state"))
    rules = view(spark, sf_dir, "alarm_rules").select("rule_id", "rule_name")
    events = lifecycle.transitions(states).select("rule_id", "episode", "ts", "event_type").join(alarms, ["rule_id", "episode"], "left").join(rules, "rule_id", "left")
    return events.withColumns({c: F.coalesce(c, F.lit("")) for c in ("alarm_state", "rule_name")})
