"""Registered queries of audit events and of tables that are committed together, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog, importer, ingest, lifecycle, projection
from ..operators.events import alarm_id, sample_id
from ..sources.snapshots import Store, batch_sink, shared_path
from . import queries as q
from . import readmodels
from .domain import view
from .queries import query

AT = "2024-02-01 00:00:00"
_AT = f"TIMESTAMP '{AT}'"
INCREMENTS = 10


def _at():
    return F.lit(AT).cast("timestamp_ntz")


# --- events in SQL ------------------------------------------------------------------------


def _hex(*parts: str) -> str:
    return f"substr(sha256(concat_ws('|', {', '.join(parts)})), 1, 12)"


def _sample(point: str = "point_id", seq: str = "ingest_seq") -> str:
    return f"concat('PS-', {point}, '-', {_hex(point, f'CAST({seq} AS VARCHAR)')})"


def _alarm(rule: str = "rule_id", episode: str = "episode") -> str:
    return f"concat('GA-', {rule}, '-', {_hex(rule, f'CAST({episode} AS VARCHAR)')})"


def _time(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def _event(frm: str, **c: str) -> str:
    """SELECT of events from rows; what is not given is empty, alarm and rule are null."""
    given = {n: c.get(n, "CAST(NULL AS VARCHAR)" if n in ("generated_alarm_id", "rule_id") else "''") for n in ("generated_alarm_id", "rule_id", "point_id", "equipment_id", "event_type", "event_timestamp", "value", "sample_id", "previous_state", "new_state", "acknowledged_by", "message", "details_json")}
    inner = ", ".join(f"{v} AS {n}" for n, v in given.items())
    key = _hex("generated_alarm_id", "rule_id", "point_id", "event_type", _time("event_timestamp"), "sample_id", "previous_state", "new_state", "details_json")
    return f"SELECT concat('AE-', {key}) AS id, * FROM (SELECT {inner} FROM {frm})"


_LOCAL = "'local-operator'"

# --- rules ----------------------------------------------------------------------------------

_CREATED = """CAST(to_json({'created_rule': {'alarm_message': r.alarm_message, 'clear_value': r.clear_value, 'delay_seconds': r.delay_seconds, 'enabled': r.enabled, 'id': r.rule_id, 'operator': r.operator, 'point_id': r.point_id, 'rule_name': r.rule_name,
 'rule_type': r.rule_type, 'severity': r.severity, 'threshold_value': r.threshold_value}}) AS VARCHAR)"""


@query(
    _event("alarm_rules r LEFT JOIN points p ON r.point_id = p.point_id AND p.u % 5 <> 0", rule_id="r.rule_id", point_id="r.point_id", equipment_id="coalesce(p.equipment_id, '')", event_type="'RULE_CREATED'", event_timestamp=_AT, acknowledged_by=_LOCAL, message="concat('Alarm rule created: ', r.rule_name)", details_json=_CREATED),
    "points",
    "alarm_rules",
)
def rule_created_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.created_events(view(spark, sf_dir, "alarm_rules"), view(spark, sf_dir, "points").where("u % 5 <> 0"), _at())


_UPDATES = """n AS (SELECT r.*, CASE WHEN u % 3 = 0 THEN '75' WHEN u % 7 = 0 THEN '' END AS n_threshold, CASE WHEN u % 4 = 0 THEN 'Warning' END AS n_severity, CASE WHEN u % 5 = 0 THEN 60 END AS n_delay, CASE WHEN u % 6 = 0 THEN false WHEN u % 6 = 1 THEN true END AS n_enabled FROM alarm_rules r),
f AS (SELECT *, n_threshold IS NOT NULL AND n_threshold <> threshold_value AS c_t, n_severity IS NOT NULL AND n_severity <> severity AS c_s, n_delay IS NOT NULL AND n_delay <> delay_seconds AS c_d, n_enabled IS NOT NULL AND n_enabled <> enabled AS c_e FROM n),
d AS (SELECT *, concat('{"changed_fields":[', concat_ws(',', CASE WHEN c_t THEN '"threshold_value"' END, CASE WHEN c_d THEN '"delay_seconds"' END, CASE WHEN c_s THEN '"severity"' END, CASE WHEN c_e THEN '"enabled"' END),
  '],"new_values":{', concat_ws(',', CASE WHEN c_d THEN concat('"delay_seconds":', n_delay) END, CASE WHEN c_e THEN concat('"enabled":', n_enabled) END, CASE WHEN c_s THEN concat('"severity":"', n_severity, '"') END, CASE WHEN c_t THEN concat('"threshold_value":"', n_threshold, '"') END),
  '},"old_values":{', concat_ws(',', CASE WHEN c_d THEN concat('"delay_seconds":', delay_seconds) END, CASE WHEN c_e THEN concat('"enabled":', enabled) END, CASE WHEN c_s THEN concat('"severity":"', severity, '"') END, CASE WHEN c_t THEN concat('"threshold_value":"', threshold_value, '"') END), '}}') AS json FROM f WHERE c_t OR c_s OR c_d OR c_e)"""


def _rule_updates(rules: DataFrame) -> DataFrame:
    """Requests to change rules, as text; a blank threshold and flags and severities in other spellings among them."""
    u, none = F.col("u"), F.lit(None).cast("string")
    return rules.select(
        "rule_id",
        F.when(u % 3 == 0, " 75 ").when(u % 7 == 0, "n/a").alias("threshold_value"),
        none.alias("clear_value"),
        F.when(u % 5 == 0, "60").alias("delay_seconds"),
        F.when(u % 4 == 0, "WARNING").alias("severity"),
        none.alias("alarm_message"),
        F.when(u % 6 == 0, "No").when(u % 6 == 1, "1").alias("enabled"),
    )


@query(
    f"{_UPDATES} {_event('d LEFT JOIN points p ON d.point_id = p.point_id', rule_id='rule_id', point_id='d.point_id', equipment_id='p.equipment_id', event_type=repr('RULE_UPDATED'), event_timestamp=_AT, acknowledged_by=_LOCAL, message='concat(' + repr('Alarm rule updated: ') + ', rule_name)', details_json='json')}",
    "points",
    "alarm_rules",
)
def rule_update_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = view(spark, sf_dir, "alarm_rules")
    return catalog.update_events(rules, _rule_updates(rules), view(spark, sf_dir, "points"), _at())


@query("SELECT rule_id, rule_name, point_id, severity FROM alarm_rules WHERE rule_id = 'R-7'", "alarm_rules")
def rule_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "alarm_rules").where("rule_id = 'R-7'").select("rule_id", "rule_name", "point_id", "severity")


@query(
    f"""{q._WHAT_IF}, w AS (SELECT w.*, p.point_name, p.display_name, p.equipment_id FROM updates w LEFT JOIN points p ON w.point_id = p.point_id)
SELECT scenario_id, CAST(count(*) AS INTEGER) AS n_points, string_agg(concat_ws('|', point_id, coalesce(point_name, point_id), coalesce(display_name, point_id), coalesce(equipment_id, '')), ';' ORDER BY position) AS affected FROM w GROUP BY scenario_id""",
    "points",
)
def scenario_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = view(spark, sf_dir, "points")
    out = readmodels.scenarios(q._what_if(points), points)
    return out.select("scenario_id", F.size("affected_points").alias("n_points"), F.array_join(F.transform("affected_points", lambda x: F.concat_ws("|", x["point_id"], x["point_name"], x["display_name"], x["equipment_id"])), ";").alias("affected"))


# --- lifecycle events -----------------------------------------------------------------------

_FACTS = f"""CAST(to_json({{'alarm_message': r.alarm_message, 'clear_value': r.clear_value, 'delay_seconds': r.delay_seconds, 'evaluation_status': s.status, 'operator': r.operator, 'rule_type': r.rule_type, 'severity': r.severity, 'threshold_value': r.threshold_value, 'triggering_quality': s.quality,
 'triggering_received_timestamp': {_time('s.received_timestamp')}, 'triggering_sample_id': {_sample('s.point_id', 's.ingest_seq')}, 'triggering_source_timestamp': {_time('s.source_timestamp')}, 'triggering_value': s.value}}) AS VARCHAR)"""
_LIFE = _event(
    "(SELECT * FROM states WHERE state <> previous_state) s JOIN alarm_rules r ON s.rule_id = r.rule_id LEFT JOIN points p ON s.point_id = p.point_id",
    generated_alarm_id=_alarm("s.rule_id", "s.episode"),
    rule_id="s.rule_id",
    point_id="s.point_id",
    equipment_id="p.equipment_id",
    event_type="CASE s.state WHEN 'PENDING' THEN 'PENDING_CREATED' WHEN 'ACTIVE' THEN 'ALARM_ACTIVATED' ELSE 'ALARM_CLEARED' END",
    event_timestamp="s.ts",
    value="s.value",
    sample_id=_sample("s.point_id", "s.ingest_seq"),
    previous_state="CASE s.previous_state WHEN 'NONE' THEN '' ELSE s.previous_state END",
    new_state="CASE s.state WHEN 'NONE' THEN 'CLEARED' ELSE s.state END",
    message="CASE s.state WHEN 'PENDING' THEN 'Pending delay' ELSE s.status END",
    details_json=_FACTS,
)
_ACK = _event(
    f"commands c JOIN alarms a USING (rule_id, episode) JOIN alarm_rules r USING (rule_id) LEFT JOIN points p ON r.point_id = p.point_id LEFT JOIN (SELECT point_id, {_sample()} AS sample FROM point_samples QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY ingest_seq DESC) = 1) l ON l.point_id = r.point_id LEFT JOIN shown USING (rule_id, episode)",
    generated_alarm_id=_alarm("c.rule_id", "c.episode"),
    rule_id="c.rule_id",
    point_id="r.point_id",
    equipment_id="p.equipment_id",
    event_type="'ALARM_ACKNOWLEDGED'",
    event_timestamp="c.acknowledged_at",
    value="shown.value",
    sample_id="l.sample",
    previous_state="a.state",
    new_state="a.state",
    acknowledged_by="c.operator",
    message="r.alarm_message",
    details_json="CAST(to_json({'acknowledged_by': c.operator}) AS VARCHAR)",
)
_SHOWN = "shown AS (SELECT rule_id, episode, value FROM states WHERE state <> 'NONE' QUALIFY row_number() OVER (PARTITION BY rule_id, episode ORDER BY ts DESC, ingest_seq DESC) = 1)"


def _full_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States with the rule, the point's equipment and the sample's id."""
    points = view(spark, sf_dir, "points").select("point_id", "equipment_id")
    return q._states(spark, sf_dir).join(points, "point_id", "left").withColumn("sample_id", sample_id(F.col("point_id"), F.col("ingest_seq")))


def _shown_alarms(states: DataFrame) -> DataFrame:
    """Alarms with the point, equipment and message of the rule and the value of the last evaluation that left them open."""
    held = F.max_by("value", F.when(F.col("state") != "NONE", F.struct("ts", "seq")))
    facts = states.groupBy("rule_id", "episode").agg(held.alias("triggered_value"), *(F.first(c).alias(c) for c in ("point_id", "equipment_id", "alarm_message")))
    return lifecycle.episodes(states).join(facts, ["rule_id", "episode"])


def _life_events(states: DataFrame) -> DataFrame:
    return lifecycle.lifecycle_events(lifecycle.transitions(states))


def _ack_events(spark: SparkSession, sf_dir: str, states: DataFrame) -> DataFrame:
    current = projection.latest(view(spark, sf_dir, "point_samples")).select("point_id", sample_id(F.col("point_id"), F.col("ingest_seq")).alias("sample_id"))
    alarms = _shown_alarms(states)
    return lifecycle.acknowledge_events(alarms, q._commands(alarms), current)


@query(f"{q._STATES} {_LIFE}", "points", *q._BASE)
def alarm_lifecycle_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _life_events(_full_states(spark, sf_dir))


@query(f"{q._ACKS}, {_SHOWN} {_ACK}", "points", *q._BASE)
def acknowledge_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ack_events(spark, sf_dir, _full_states(spark, sf_dir))


@query(
    f"""{q._ACKS}, {_SHOWN}, events AS ({_LIFE} UNION ALL {_ACK}),
made AS (SELECT {_alarm()} AS generated_alarm_id, alarm_message FROM alarms JOIN alarm_rules USING (rule_id) WHERE episode % 5 <> 0)
SELECT v.*, coalesce(r.rule_name, '') AS rule_name, coalesce(p.point_name, '') AS point_name, coalesce(p.display_name, '') AS display_name, coalesce(e.equipment_type, '') AS equipment_type, coalesce(e.location, '') AS location, coalesce(made.alarm_message, '') AS generated_alarm_message
FROM events v LEFT JOIN alarm_rules r ON v.rule_id = r.rule_id AND r.u % 11 <> 1 LEFT JOIN points p ON v.point_id = p.point_id LEFT JOIN equipment e ON v.equipment_id = e.equipment LEFT JOIN made ON v.generated_alarm_id = made.generated_alarm_id""",
    "points",
    "equipment",
    *q._BASE,
)
def alarm_events_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events of alarms with rule, point, equipment and alarm, newest first; some rules and alarms are gone."""
    states = _full_states(spark, sf_dir)
    events = _life_events(states).unionByName(_ack_events(spark, sf_dir, states))
    alarms = _shown_alarms(states).where("episode % 5 <> 0").select(alarm_id(F.col("rule_id"), F.col("episode")).alias("id"), "alarm_message")
    return readmodels.event_view(events, view(spark, sf_dir, "alarm_rules").where("u % 11 <> 1"), view(spark, sf_dir, "points"), view(spark, sf_dir, "equipment"), alarms)


@query(
    f"""{q._STALE}, f AS (SELECT point_id, ingest_seq, min(tick) AS tick FROM stale GROUP BY ALL)
{_event('f JOIN point_samples s USING (point_id, ingest_seq) LEFT JOIN points p USING (point_id)', point_id='point_id', equipment_id='p.equipment_id', event_type=repr('POINT_STALE'), event_timestamp='f.tick', value='s.value', sample_id=_sample(), previous_state=repr('Not stale'), new_state=repr('Stale'), acknowledged_by=_LOCAL, message='concat(' + repr('Point sample is stale: ') + ', p.display_name)',
 details_json='CAST(to_json({' + f"'evaluation_timestamp': {_time('f.tick')}, 'quality': s.quality, 'received_timestamp': {_time('s.received_timestamp')}, 'source': s.source, 'source_timestamp': {_time('s.source_timestamp')}, 'stale_after_seconds': s.stale_after_seconds" + '}) AS VARCHAR)')}""",
    "points",
    "point_samples",
)
def stale_event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """POINT_STALE at the first sweep that finds a sample stale."""
    first = ingest.first_stale(q._sweeps(spark, sf_dir)).select("point_id", "ingest_seq", "tick")
    rows = first.join(view(spark, sf_dir, "point_samples"), ["point_id", "ingest_seq"]).withColumn("sample_id", sample_id(F.col("point_id"), F.col("ingest_seq")))
    return ingest.stale_events(rows, view(spark, sf_dir, "points"), F.col("tick"))


# --- imports that are committed or refused ----------------------------------------------------

_ALLOWED = "analog, bit, bool, boolean, enum, float, float32, float64, int16, int32, integer, uint16, uint32"
_CLASH = """SELECT row_number, 'register_address' AS field, concat('Modbus address conflicts with existing point ', address_owner) AS message FROM conf WHERE address_owner IS NOT NULL
 UNION ALL SELECT row_number, 'point_name', concat('Point already exists with different protocol/address metadata: ', point_id) FROM conf WHERE metadata_conflict"""


@query(
    f"""{q._ROWS} SELECT row_number, 'slave_id' AS field, 'slave_id must be an integer from 1 to 247' AS message FROM n2 WHERE NOT s_ok UNION ALL SELECT row_number, 'function_code', 'function_code must be an integer from 1 to 4' FROM n2 WHERE NOT f_ok
 UNION ALL SELECT row_number, 'register_address', 'register_address must be an integer from 0 to 65535' FROM n2 WHERE NOT r_ok UNION ALL SELECT row_number, 'data_type', 'data_type must be one of: {_ALLOWED}' FROM n2 WHERE NOT d_ok
 UNION ALL SELECT row_number, 'scale', CASE WHEN scale_missing THEN 'Missing required field: scale' ELSE 'scale must be a number' END FROM n2 WHERE scale_n IS NULL
 UNION ALL SELECT row_number, field, message FROM dups UNION ALL {_CLASH}""",
    *q._IMPORT,
)
def import_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importer.row_errors(q._import(spark, sf_dir), view(spark, sf_dir, "points"), view(spark, sf_dir, "equipment"))


_CLEAN = f"""{q._ROWS}, errs AS (SELECT row_number FROM n2 WHERE issues > 0 UNION ALL SELECT row_number FROM dups UNION ALL SELECT row_number FROM ({_CLASH})), ok AS (SELECT * FROM conf WHERE row_number NOT IN (SELECT row_number FROM errs))"""


def _catalog(spark: SparkSession, sf_dir: str) -> Store:
    """A fresh store with the catalog: points with all columns, equipment, no events."""
    store = Store(spark, shared_path(spark, "catalog"))
    points, equipment = view(spark, sf_dir, "points"), view(spark, sf_dir, "equipment")
    tx = store.begin()
    tx.replace("points", points.drop("u").withColumns({"source_system": F.lit(""), "description": F.lit(""), "created_at": _at(), "updated_at": _at()}), "point_id")
    tx.replace("equipment", equipment, "equipment")
    tx.replace("alarm_events", catalog.created_events(view(spark, sf_dir, "alarm_rules").limit(0), points, _at()))
    tx.commit()
    return store


def _imported(spark: SparkSession, sf_dir: str) -> Store:
    """The store after two files: the register map as it is, which has errors and changes nothing, and a file of its error-free rows."""
    store = _catalog(spark, sf_dir)
    rows = q._import(spark, sf_dir)
    refused = importer.commit_import(store.begin(), rows, _at(), "registers.csv")
    tx = store.begin()
    clean = importer.without_errors(rows, tx.table("points"), tx.table("equipment"))
    done = importer.commit_import(tx, clean, _at(), "clean.csv")
    if refused["committed"] or not done["committed"]:
        raise AssertionError("a file with errors was committed, or one without was not")
    return store


_COMMITTED = f"""{_CLEAN}, counts AS (SELECT arg_min(point_id, row_number) AS point_id, arg_min(equipment_id, row_number) AS equipment_id, count(*) AS n, count(DISTINCT CASE WHEN equipment_id NOT IN (SELECT equipment FROM equipment) THEN equipment_id END) AS e,
 count(*) FILTER (WHERE action = 'create_point') AS c, count(*) FILTER (WHERE action = 'update_point_metadata') AS f, count(*) FILTER (WHERE action = 'skip_existing_point') AS k FROM ok)"""


@query(
    f"{_COMMITTED} " + _event("counts", point_id="point_id", equipment_id="equipment_id", event_type="'MODBUS_IMPORT_COMMITTED'", event_timestamp=_AT, acknowledged_by=_LOCAL, message="'Static Modbus register map imported into equipment and point records'", details_json="CAST(to_json({'created_equipment_count': e, 'created_point_count': c, 'csv_path': 'clean.csv', 'row_count': n, 'skipped_row_count': k, 'updated_point_count': f}) AS VARCHAR)"),
    *q._IMPORT,
)
def import_commit_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of the store after both files: one, of the file without errors."""
    return _imported(spark, sf_dir).table("alarm_events")


@query(
    f"""{_CLEAN} SELECT point_id, equipment_id, protocol, address, created_at, updated_at FROM (
 SELECT point_id, equipment_id, 'modbus' AS protocol, address, {_AT} AS created_at, {_AT} AS updated_at FROM ok WHERE action = 'create_point'
 UNION ALL SELECT p.point_id, p.equipment_id, coalesce(CASE WHEN ok.action = 'update_point_metadata' THEN 'modbus' END, p.protocol), coalesce(CASE WHEN ok.action = 'update_point_metadata' THEN ok.address END, p.address), {_AT}, {_AT} FROM points p LEFT JOIN ok ON ok.point_id = p.point_id)""",
    *q._IMPORT,
)
def import_committed_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All points of the store after both files."""
    return _imported(spark, sf_dir).table("points").select("point_id", "equipment_id", "protocol", "address", "created_at", "updated_at")


# --- increments that are committed -------------------------------------------------------------


def _increments(spark: SparkSession, sf_dir: str, parts: int) -> list[DataFrame]:
    """All raw samples in parts by arrival."""
    raw = q.raw_samples(spark, sf_dir)
    span = raw.agg(F.min("ingest_seq").alias("a"), F.max("ingest_seq").alias("b")).first()
    if span["a"] is None:
        return []
    step = (span["b"] - span["a"]) // parts + 1
    return [raw.where(F.col("ingest_seq").between(span["a"] + i * step, span["a"] + (i + 1) * step - 1)) for i in range(parts)]


def _with_points(spark: SparkSession, sf_dir: str) -> Store:
    store = Store(spark, shared_path(spark, "telemetry"))
    tx = store.begin()
    tx.replace("points", view(spark, sf_dir, "points"), "point_id")
    tx.commit()
    return store


def _ingested(spark: SparkSession, sf_dir: str) -> Store:
    """The store after all samples came in ten increments, each committed before the next."""
    store = _with_points(spark, sf_dir)
    for part in _increments(spark, sf_dir, INCREMENTS):
        tx = store.begin()
        ingest.ingest_increment(tx, part, _at())
        tx.commit()
    return store


def _streamed(spark: SparkSession, sf_dir: str) -> Store:
    """The store after all samples came as a stream of files, two in each micro-batch."""
    store, files, marks = _with_points(spark, sf_dir), shared_path(spark, "arriving"), shared_path(spark, "stream")
    raw = q.raw_samples(spark, sf_dir)
    for part in _increments(spark, sf_dir, 6):
        part.coalesce(1).write.mode("append").parquet(files)  # one after the other, as files arrive
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 2).parquet(files)
    sink = batch_sink(store.root, "samples", lambda tx, batch: ingest.ingest_increment(tx, batch, _at()))
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return store


_NOW = f"""{q._SPOILT} SELECT point_id, value, quality, source_timestamp, sample_id FROM (SELECT c.point_id, c.value, CASE quality WHEN 'UNKNOWN' THEN 'UNCERTAIN' ELSE quality END AS quality,
 CASE WHEN ingest_seq % 41 = 0 THEN NULL WHEN ingest_seq % 43 = 0 THEN {_AT} ELSE CAST(date_trunc('second', ts) AS TIMESTAMP) END AS source_timestamp, {_sample('c.point_id')} AS sample_id FROM c WHERE error IS NULL QUALIFY row_number() OVER (PARTITION BY c.point_id ORDER BY ingest_seq DESC) = 1)"""


@query(_NOW, "points", "point_samples")
def committed_current_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current values after ten increments, which a rebuild from all samples must equal."""
    return _ingested(spark, sf_dir).table("current_point_values").select("point_id", "value", "quality", "source_timestamp", "sample_id")


@query(_NOW, "points", "point_samples")
def streamed_current_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current values after a stream of the same samples."""
    return _streamed(spark, sf_dir).table("current_point_values").select("point_id", "value", "quality", "source_timestamp", "sample_id")


def _change(kind: str, name: str, column: str, old: str, new: str, flag: bool) -> str:
    shown = (lambda x: f"CASE WHEN {x} THEN 'True' ELSE 'False' END") if flag else (lambda x: x)
    return "SELECT * FROM (" + _event(
        f"(SELECT * FROM g WHERE {old} <> {new}) g LEFT JOIN points p ON g.point_id = p.point_id",
        point_id="g.point_id",
        equipment_id="p.equipment_id",
        event_type=f"'{kind}'",
        event_timestamp=_AT,
        value="g.value",
        sample_id=_sample("g.point_id"),
        previous_state=shown(old),
        new_state=shown(new),
        acknowledged_by=_LOCAL,
        message=f"concat('Point {name} changed from ', {shown(old)}, ' to ', {shown(new)})",
        details_json=f"CAST(to_json({{'changed_field': '{column}', 'new_value': {new}, 'old_value': {old}}}) AS VARCHAR)",
    ) + ")"


@query(
    f"""{q._SPOILT}, g0 AS (SELECT c.*, CASE quality WHEN 'UNKNOWN' THEN 'UNCERTAIN' ELSE quality END AS nq FROM c WHERE error IS NULL),
g AS (SELECT *, lag(nq) OVER w AS pq, lag(overridden) OVER w AS po, lag(out_of_service) OVER w AS ps FROM g0 WINDOW w AS (PARTITION BY point_id ORDER BY ingest_seq))
{_change('POINT_QUALITY_CHANGED', 'quality', 'quality', 'pq', 'nq', False)} UNION ALL {_change('POINT_OVERRIDE_CHANGED', 'override', 'overridden', 'po', 'overridden', True)} UNION ALL {_change('POINT_OUT_OF_SERVICE_CHANGED', 'out-of-service', 'out_of_service', 'ps', 'out_of_service', True)}""",
    "points",
    "point_samples",
)
def committed_health_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of health after ten increments; changes across two increments are among them."""
    return _ingested(spark, sf_dir).table("alarm_events")
