"""Registered queries of the operations context, of loaders and files, and of streams, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as r
from ..functions import text as t
from ..operators import importer, ingest, projection
from ..operators.events import alarm_id, sample_id
from ..sources import briefing, files
from ..sources.snapshots import Store, shared_path
from ..streaming.health import streaming_stale_points
from ..streaming.lifecycle import PROVIDER, lifecycle_sink
from . import audit_queries as a
from . import queries as q
from . import readmodels
from .domain import TICK_SECONDS as STALE_TICKS
from .domain import view
from .queries import query

# --- operations context from the orders, customers and parts ----------------------------------

_SCENARIOS = "SELECT concat('S-', CAST(o_orderkey AS {string})) AS id, o_orderpriority AS risk_level, o_orderdate AS start_time FROM {orders} WHERE o_orderstatus = 'P'"
_TURNOVERS = "SELECT concat('H-', CAST(o_orderkey AS {string})) AS id, o_orderdate AS shift_date, concat(' ', o_orderpriority, '; ;', o_orderstatus, ';') AS watch_items, CASE WHEN o_orderkey % 3 = 0 THEN 'n/a' ELSE concat('call ', o_orderstatus) END AS open_actions FROM {orders} WHERE o_orderkey % 4 = 0"
_PROCEDURES = "SELECT CAST(p_partkey AS {string}) AS id, CASE p_size % 4 WHEN 0 THEN 'SOP' WHEN 1 THEN 'EOP' WHEN 2 THEN 'MOP' ELSE 'ARP' END AS procedure_type, p_brand AS procedure_code FROM {part}"
_REPORTS = "SELECT concat('L-', CAST(c_custkey AS {string})) AS id, CAST(floor(c_acctbal / 100) AS BIGINT) AS period_end, CAST(c_acctbal AS DOUBLE) AS oos_hours FROM {customer}"
_PLACE = "CAST(row_number() OVER (ORDER BY {o}) AS BIGINT) AS place"


def _context(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    frames = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("orders", "part", "customer") if f"{{{n}}}" in sql}
    return spark.sql(sql.format(string="STRING", **{n: f"{{{n}}}" for n in frames}), **frames)


def _sql(sql: str) -> str:
    return sql.format(string="VARCHAR", orders="orders", part="part", customer="customer")


@query(f"SELECT *, {_PLACE.format(o='start_time DESC, id')} FROM ({_sql(_SCENARIOS)})")
def facility_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenarios with their place in the order."""
    return readmodels.numbered(readmodels.facility_scenarios(_context(spark, sf_dir, _SCENARIOS)), F.desc("start_time"), "id")


@query(f"SELECT id, start_time FROM ({_sql(_SCENARIOS)}) ORDER BY start_time DESC, id LIMIT 1")
def active_scenario(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readmodels.first_row(_context(spark, sf_dir, _SCENARIOS), F.desc("start_time"), "id").select("id", "start_time")


@query(
    f"""SELECT id, shift_date, concat_ws('|', trim(string_split(watch_items, ';')[1]), trim(string_split(watch_items, ';')[3])) AS watch, CASE WHEN open_actions = 'n/a' THEN '' ELSE open_actions END AS actions, {_PLACE.format(o="shift_date DESC, id")} FROM ({_sql(_TURNOVERS)})"""
)
def shift_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = readmodels.shift_turnover(_context(spark, sf_dir, _TURNOVERS))
    out = out.select("id", "shift_date", F.array_join("watch_item_list", "|").alias("watch"), F.array_join(F.when(t.has_value(F.col("open_actions")), F.col("open_action_list")).otherwise(F.array()), "|").alias("actions"))
    return readmodels.numbered(out, F.desc("shift_date"), "id")


@query(f"SELECT *, {_PLACE.format(o='''CASE procedure_type WHEN 'EOP' THEN 0 WHEN 'MOP' THEN 1 WHEN 'SOP' THEN 2 ELSE 3 END, procedure_code, id''')} FROM ({_sql(_PROCEDURES)})")
def procedure_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = readmodels.procedure_references(_context(spark, sf_dir, _PROCEDURES)).withColumn("kind", readmodels.ranked("procedure_type", "EOP", "MOP", "SOP"))
    return readmodels.numbered(out, "kind", "procedure_code", "id").drop("kind")


@query(f"SELECT *, {_PLACE.format(o='period_end DESC, id')} FROM ({_sql(_REPORTS)})")
def reliability_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readmodels.numbered(readmodels.reliability_reports(_context(spark, sf_dir, _REPORTS)), F.desc("period_end"), "id")


@query(f"SELECT id, period_end FROM ({_sql(_REPORTS)}) ORDER BY period_end DESC, id LIMIT 1")
def latest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readmodels.first_row(_context(spark, sf_dir, _REPORTS), F.desc("period_end"), "id").select("id", "period_end")


_CORRELATIONS = "SELECT CAST(c_custkey AS {string}) AS id, CAST(c_nationkey AS BIGINT) AS window_start, concat('E', CAST(c_nationkey AS {string}), '; ;E0') AS impacted_equipment FROM {customer}"
_MEMBERS = "SELECT CAST(o_orderkey AS {string}) AS id, CAST(o_custkey AS {string}) AS correlation_id, concat('R-', CAST(o_orderkey % 40 AS {string})) AS alarm_rule_id, concat('PT-', CAST(o_orderkey % 50 AS {string})) AS point_id, CAST(o_custkey % 30 AS {string}) AS equipment_id, o_orderpriority AS contribution, o_orderstatus AS evidence FROM {orders}"


@query(
    f"""c AS ({_sql(_CORRELATIONS)}), m AS ({_sql(_MEMBERS)}),
n AS (SELECT m.correlation_id, count(*) AS members, sha256(string_agg(concat_ws('|', m.id, m.alarm_rule_id, coalesce(r.rule_name, ''), coalesce(r.severity, ''), m.point_id, coalesce(p.point_name, ''), m.equipment_id, m.contribution, m.evidence), ';' ORDER BY m.id)) AS listed
      FROM m LEFT JOIN alarm_rules r ON m.alarm_rule_id = r.rule_id LEFT JOIN points p ON m.point_id = p.point_id GROUP BY ALL)
SELECT c.id, CAST(coalesce(n.members, 0) AS INTEGER) AS members, coalesce(n.listed, sha256('')) AS listed, concat_ws('|', trim(string_split(impacted_equipment, ';')[1]), 'E0') AS impacted, {_PLACE.format(o='window_start DESC, c.id')} FROM c LEFT JOIN n ON c.id = n.correlation_id""",
    "points",
    "alarm_rules",
)
def alarm_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations with their members, each with rule and point; those without members have none."""
    out = readmodels.alarm_correlations(_context(spark, sf_dir, _CORRELATIONS), _context(spark, sf_dir, _MEMBERS), view(spark, sf_dir, "alarm_rules"), view(spark, sf_dir, "points"))
    shown = ("member_id", "rule_id", "rule_name", "severity", "point_id", "point_name", "equipment_id", "contribution", "evidence")
    listed = F.sha2(F.array_join(F.transform("members", lambda m: F.concat_ws("|", *(m[c] for c in shown))), ";"), 256)
    out = out.select("id", "window_start", F.size("members").alias("members"), listed.alias("listed"), F.array_join("impacted_equipment_list", "|").alias("impacted"))
    return readmodels.numbered(out, F.desc("window_start"), "id").drop("window_start")


@query(
    """SELECT 'equipment' AS name, count(*) AS n FROM equipment UNION ALL SELECT 'points', count(*) FROM points UNION ALL SELECT 'alarm_rules', count(*) FROM alarm_rules UNION ALL SELECT 'point_samples', count(*) FROM point_samples""",
    "equipment",
    "points",
    *q._BASE,
)
def operational_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readmodels.operational_counts({n: view(spark, sf_dir, n) for n in ("equipment", "points", "alarm_rules", "point_samples")})


# --- loaders and files ---------------------------------------------------------------------

_WORDS = """SELECT p_partkey, CASE p_partkey % 16 WHEN 0 THEN ' 12.7 ' WHEN 1 THEN 'N/A' WHEN 2 THEN '-5' WHEN 3 THEN 'soon' WHEN 4 THEN 'inf' WHEN 5 THEN '1e3' WHEN 6 THEN 'Yes' WHEN 7 THEN 'no' WHEN 8 THEN 'ON' WHEN 9 THEN 'off' WHEN 10 THEN 'unknown' WHEN 11 THEN 'good'
  WHEN 12 THEN ' ' WHEN 13 THEN '1' WHEN 14 THEN '0' ELSE CAST(p_size AS {string}) END AS word FROM {part}"""


@query(
    f"""WITH w AS (SELECT *, lower(trim(word)) AS x FROM ({_sql(_WORDS)})), n AS (SELECT *, CASE WHEN x IN ('', 'null', 'none', 'n/a', 'inf') THEN NULL ELSE TRY_CAST(x AS DOUBLE) END AS v FROM w)
SELECT p_partkey, CAST(greatest(coalesce(trunc(v), 300), 0) AS BIGINT) AS stale_after, CAST(coalesce(trunc(v), 0) AS BIGINT) AS delay, x NOT IN ('', 'false', '0', 'no', 'off') AS flag, x IN ('1', 'true', 'yes', 'on') AS replay_flag,
 CASE WHEN x IN ('1', 'true', 'yes') THEN true WHEN x IN ('0', 'false', 'no') THEN false END AS enabled, CASE WHEN x IN ('', 'n/a', 'unknown') THEN 'UNCERTAIN' ELSE upper(x) END AS loader_quality FROM n"""
)
def loader_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the parsers of seeds, replays and rules make of the same texts."""
    w = F.col("word")
    put = {"stale_after": t.stale_after(w), "delay": t.delay_seconds(w), "flag": t.flag(w), "replay_flag": t.replay_flag(w), "enabled": t.enabled(w), "loader_quality": t.loader_quality(w)}
    return _context(spark, sf_dir, _WORDS).select("p_partkey", *(c.alias(n) for n, c in put.items()))


@query(f"SELECT rule_id, {a._sample('point_id', 'u')} AS sample_id, {a._alarm('rule_id', 'u')} AS alarm_id FROM alarm_rules", "alarm_rules")
def synthesised_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "alarm_rules").select("rule_id", sample_id(F.col("point_id"), F.col("u")).alias("sample_id"), alarm_id(F.col("rule_id"), F.col("u")).alias("alarm_id"))


@query(
    f"""x AS (SELECT r.*, s.value, s.quality, s.overridden, s.out_of_service, s.received_timestamp, s.stale_after_seconds, s.ts AS eval_at, s.ingest_seq, CASE WHEN ingest_seq % 5 = 0 THEN 'trend' ELSE rule_type END AS rt, CASE WHEN ingest_seq % 3 = 0 THEN '~' ELSE operator END AS op FROM point_samples s JOIN alarm_rules r ON s.point_id = r.point_id),
e AS (SELECT ingest_seq, rt, op, {q._STATUS} AS status FROM x)
SELECT CASE WHEN status NOT IN ('Triggered', 'Normal') THEN status WHEN rt = 'trend' THEN 'Unsupported rule type' WHEN op = '~' THEN 'Unsupported operator' ELSE status END AS status, count(*) AS n FROM e GROUP BY 1""",
    *q._BASE,
)
def unsupported_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses where rules have types and operators that no evaluation knows."""
    seq = F.col("ingest_seq")
    df = view(spark, sf_dir, "point_samples").join(view(spark, sf_dir, "alarm_rules"), "point_id").withColumn("evaluated_at", F.col("ts"))
    df = df.withColumns({"rule_type": F.when(seq % 5 == 0, "trend").otherwise(F.col("rule_type")), "operator": F.when(seq % 3 == 0, "~").otherwise(F.col("operator"))})
    return r.evaluate(df).groupBy("status").agg(F.count("*").alias("n"))


@query(
    """SELECT s.point_id, coalesce(p.equipment_id, '') AS equipment_id, s.quality, s.overridden, s.out_of_service FROM (SELECT * FROM point_samples QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY ingest_seq DESC) = 1) s LEFT JOIN points p ON s.point_id = p.point_id AND p.u % 3 <> 0""",
    "points",
    "point_samples",
)
def health_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readmodels.health_projection(projection.latest(view(spark, sf_dir, "point_samples")), view(spark, sf_dir, "points").where("u % 3 <> 0"))


_FILE = "device_name, slave_id, function_code, register_address, point_name, data_type, scale, unit, description"


def _register_files(spark: SparkSession, sf_dir: str) -> list[str]:
    """The register map as CSV files in the shared folder, and a path where no file is."""
    folder = shared_path(spark, "registers")
    rows = view(spark, sf_dir, "register_map").select(*_FILE.split(", "))
    rows.write.option("header", True).option("escape", '"').csv(folder)
    return [*_parts(spark, folder), f"{folder}/none.csv"]


def _parts(spark: SparkSession, folder: str) -> list[str]:
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
    return sorted(s.getPath().toString() for s in found if s.getPath().getName().startswith("part-"))


@query(f"SELECT {_FILE}, NULL AS field FROM register_map UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'csv_path'", "register_map")
def register_map_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records of the files and the issue of the one that is missing."""
    rows, issues = files.read_register_maps(spark, _register_files(spark, sf_dir))
    return rows.select(*_FILE.split(", ")).unionByName(issues.select("field"), allowMissingColumns=True)


_LOG = "SELECT CASE WHEN severity = '1-URGENT' THEN 'Critical' ELSE severity END AS severity, source, equipment, concat('order ', CAST(l_orderkey AS {string}), ' line ', CAST(l_linenumber AS {string})) AS alarm, CASE status WHEN 'O' THEN 'Active' ELSE 'Cleared' END AS status, ts AS timestamp FROM {log}"
_SECTION = "SELECT {n} AS section, -count(*) AS first, {c} AS key, concat('- ', {c}, ': ', count(*)) AS line FROM l GROUP BY {c}"


@query(
    f"""l AS ({_LOG.format(string='VARCHAR', log='alarm_log')})
SELECT section, first, key, line FROM (SELECT 1 AS section, 0 AS first, '' AS key, concat('The alarm log contains ', count(*), ' total alarm records.') AS line FROM l UNION ALL {_SECTION.format(n=3, c='severity')} UNION ALL {_SECTION.format(n=5, c='source')} UNION ALL {_SECTION.format(n=7, c='equipment')}
 UNION ALL SELECT 9, 0, concat_ws(',', strftime(timestamp, '%Y-%m-%d'), source, equipment, alarm), concat('- ', concat_ws(' | ', strftime(timestamp, '%Y-%m-%d'), source, equipment, alarm)) FROM l WHERE severity = 'Critical' AND status = 'Active')""",
    "alarm_log",
)
def briefing_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the briefing that come from the log, with their places."""
    log = view(spark, sf_dir, "alarm_log")
    log = spark.sql(_LOG.format(string="STRING", log="{log}"), log=log).withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd"))
    out = briefing.briefing_lines(log).where("section in (1, 3, 5, 7, 9)")
    return out.select("section", F.col("first").cast("bigint").alias("first"), F.array_join("key", ",").alias("key"), "line")


_REPLAY = "sequence, point_id, value, quality, source_timestamp, source, protocol, address, stale_after_seconds, overridden, out_of_service"


@query(
    """SELECT CASE WHEN ingest_seq % 9 = 0 THEN 'x' ELSE CAST(day(ts) AS VARCHAR) END AS sequence, point_id, value, CASE WHEN ingest_seq % 10 = 4 THEN 'GOOD' ELSE quality END AS quality, strftime(ts, '%Y-%m-%d %H:%M:%S') AS source_timestamp, 'SIMULATED' AS source, 'CSV_REPLAY' AS protocol,
 CAST(ingest_seq AS VARCHAR) AS address, '21600' AS stale_after_seconds, overridden, false AS out_of_service,
 CAST(row_number() OVER (ORDER BY CASE WHEN ingest_seq % 9 = 0 THEN 99 ELSE day(ts) END, ingest_seq) AS BIGINT) AS place FROM point_samples""",
    "point_samples",
)
def replay_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples written as a replay file and read back in the order of the replay, with their places; blanks have their defaults and flags that are no words are false."""
    seq, folder = F.col("ingest_seq"), shared_path(spark, "replay")
    rows = view(spark, sf_dir, "point_samples").select(
        F.when(seq % 9 == 0, " x ").otherwise(F.dayofmonth("ts").cast("string")).alias("sequence"),
        "point_id",
        "value",
        F.when(seq % 10 == 4, F.lit(" ")).otherwise(F.col("quality")).alias("quality"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("source_timestamp"),
        F.lit("").alias("source"),
        F.lit("").alias("protocol"),
        seq.cast("string").alias("address"),
        "stale_after_seconds",
        F.when(F.col("overridden"), "On").otherwise("no").alias("overridden"),
        F.when(F.col("out_of_service"), "maybe").otherwise("").alias("out_of_service"),
    )
    rows.orderBy(seq).coalesce(1).write.option("header", True).option("escape", '"').option("emptyValue", "").csv(folder)
    out = files.read_replay(spark, next(iter(_parts(spark, folder))))
    number = F.col("sequence").try_cast("bigint")
    return readmodels.numbered(out, number.isNull(), number, "sequence", "row_number").select(*_REPLAY.split(", "), "place")


@query(
    f"""v AS (SELECT s.*, p.unit AS u, p.point_id IS NOT NULL AS known FROM (SELECT * FROM point_samples QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY ingest_seq DESC) = 1) s LEFT JOIN points p ON s.point_id = p.point_id AND p.point_id NOT LIKE '%4')
SELECT {a._sample('point_id', "concat('CPV-', point_id)")} AS sample_id, point_id, value, coalesce(u, '') AS unit, CASE quality WHEN 'UNKNOWN' THEN 'UNCERTAIN' ELSE quality END AS quality, CASE WHEN point_id LIKE '%3' THEN {a._AT} ELSE CAST(date_trunc('second', ts) AS TIMESTAMP) END AS source_timestamp,
 {a._AT} AS received_timestamp, source, '' AS protocol, '' AS address, CAST(300 AS BIGINT) AS stale_after_seconds, false AS overridden, false AS out_of_service, 'loader' AS created_by FROM v""",
    "points",
    "point_samples",
)
def loaded_seed_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points and current values written as seed files and loaded into a store: the samples that the load makes of the values. Some values are of points that the catalog lacks, some have no time."""
    folder, store = shared_path(spark, "seeds"), Store(spark, shared_path(spark, "loaded"))
    points = view(spark, sf_dir, "points").where(~F.col("point_id").endswith("4"))
    blank = F.lit("")
    points = points.select(F.col("point_id").alias("id"), "equipment_id", "point_name", "display_name", "point_type", "data_type", F.when(F.col("unit") == "", "null").otherwise(F.col("unit")).alias("unit"), *(blank.alias(c) for c in ("normal_min", "normal_max", "source_system", "description", "created_at", "updated_at")))
    values = projection.latest(view(spark, sf_dir, "point_samples"))
    taken = F.when(F.col("point_id").endswith("3"), blank).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    values = values.select(F.concat(F.lit("CPV-"), "point_id").alias("id"), "point_id", "value", "quality", "source", taken.alias("updated_at"))
    for name, df in (("points", points), ("current_point_values", values)):
        df.coalesce(1).write.option("header", True).option("escape", '"').option("emptyValue", "").csv(f"{folder}/{name}")
    named = {n: next(iter(_parts(spark, f"{folder}/{n}"))).removeprefix(f"{folder}/") for n in ("points", "current_point_values")}
    named = {n: p.split(f"/{n}/")[-1] for n, p in named.items()}
    files.load_seeds(spark, folder, {n: f"{n}/{p}" for n, p in named.items()}, store.root, F.lit(a.AT).cast("timestamp_ntz"))
    return store.table("point_samples")


@query("SELECT CAST(to_json({'rule_id': rule_id, 'enabled': enabled, 'delay_seconds': delay_seconds, 'clear_value': CASE WHEN clear_value = '' THEN NULL ELSE clear_value END}) AS VARCHAR) AS json FROM alarm_rules", "alarm_rules")
def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = view(spark, sf_dir, "alarm_rules").select("rule_id", "enabled", "delay_seconds", F.nullif(F.col("clear_value"), F.lit("")).alias("clear_value"))
    return readmodels.as_json(rules)


_TIMELINE = "SELECT CAST(o_orderkey AS {string}) AS id, o_orderdate AS event_timestamp, CAST(o_custkey % 150 AS {string}) AS equipment_id, CASE o_orderkey % 3 WHEN 0 THEN 'Active' WHEN 1 THEN 'Planned' ELSE 'Returned' END AS status FROM {orders}"
_OOS = "CASE status WHEN 'Active' THEN 0 WHEN 'Planned' THEN 1 ELSE 2 END, event_timestamp, id"
_SHOWN = "t.id, t.equipment_id, coalesce(e.equipment_type, '') AS equipment_type, coalesce(e.location, '') AS location"


@query(f"t AS ({_sql(_TIMELINE)}) SELECT {_SHOWN}, {_PLACE.format(o='event_timestamp, id')} FROM t LEFT JOIN equipment e ON t.equipment_id = e.equipment", "equipment")
def incident_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = readmodels.incident_timeline(_context(spark, sf_dir, _TIMELINE), view(spark, sf_dir, "equipment"))
    return readmodels.numbered(out, "event_timestamp", "id").select("id", "equipment_id", "equipment_type", "location", "place")


@query(f"t AS ({_sql(_TIMELINE)}) SELECT {_SHOWN}, status, {_PLACE.format(o=_OOS)} FROM t LEFT JOIN equipment e ON t.equipment_id = e.equipment", "equipment")
def equipment_out_of_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _context(spark, sf_dir, _TIMELINE).withColumnRenamed("event_timestamp", "started_at")
    out = readmodels.equipment_out_of_service(rows, view(spark, sf_dir, "equipment")).withColumn("rank", readmodels.ranked("status", "Active", "Planned"))
    return readmodels.numbered(out, "rank", "started_at", "id").select("id", "equipment_id", "equipment_type", "location", "status", "place")


@query(f"{q._ACKS} SELECT k.rule_id, episode FROM k JOIN alarm_rules r USING (rule_id) WHERE k.state = 'CLEARED' AND r.severity = 'Critical' AND acknowledged", *q._BASE)
def filtered_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alarms by all three filters at once."""
    alarms = q._acknowledged(spark, sf_dir).join(view(spark, sf_dir, "alarm_rules").select("rule_id", "severity"), "rule_id")
    return readmodels.filtered_alarms(alarms, state="CLEARED", severity="Critical", acknowledged=True).select("rule_id", "episode")


@query(
    "SELECT point_id, CASE WHEN u % 2 = 0 THEN 'kept' ELSE 'new' END AS unit, CASE WHEN u % 3 = 0 THEN 'kept' ELSE concat('d', u) END AS description, 'modbus' AS protocol FROM points",
    "points",
)
def filled_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An import over points without protocol and address: blank units and descriptions are filled, others stay."""
    u = F.col("u")
    points = view(spark, sf_dir, "points").withColumns({"unit": F.when(u % 2 == 0, "kept").otherwise(""), "description": F.when(u % 3 == 0, "kept").otherwise(""), "protocol": F.lit(""), "address": F.lit(""), "source_system": F.lit("")})
    rows = points.select("point_id", "equipment_id", u.alias("row_number"), F.lit(True).alias("complete"), F.lit("new").alias("unit"), F.concat(F.lit("d"), u).alias("description"), F.lit("BMS").alias("source_system"), F.lit("modbus").alias("protocol"), F.concat(F.lit("a"), u).alias("address"),
                         "point_name", "display_name", "point_type", "data_type", *(F.lit("").alias(c) for c in ("equipment_type", "location", "criticality")))
    _, _, filled = importer.committed(rows, points, view(spark, sf_dir, "equipment"), F.lit(a.AT).cast("timestamp_ntz"))
    return filled.select("point_id", "unit", "description", "protocol")


@query("SELECT 'point_samples' AS name, count(*) AS n FROM point_samples WHERE ingest_seq % 2 = 0 UNION ALL SELECT 'current_point_values', count(DISTINCT point_id) FROM point_samples WHERE ingest_seq % 2 = 0 UNION ALL SELECT 'alarm_events', 0 UNION ALL SELECT 'failed_samples', 0 UNION ALL SELECT 'points', count(*) FROM points", "points", "point_samples")
def reset_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a store holds after all samples came in and the operational tables were reset to a seed of every second sample."""
    store = a._ingested(spark, sf_dir)
    seed = view(spark, sf_dir, "point_samples").where("ingest_seq % 2 = 0")
    tx = store.begin()
    ingest.reset(tx, seed)
    tx.commit()
    return readmodels.operational_counts({n: store.table(n) for n in ("point_samples", "current_point_values", "alarm_events", "failed_samples", "points")})


# --- streams -------------------------------------------------------------------------------


@query(f"{q._EVENTS} SELECT rule_id, ts, ingest_seq AS seq, episode, event_type, event_previous_state, event_new_state FROM transitions", *q._BASE)
def streamed_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All evaluations as a stream in four micro-batches by time; each is run on top of the states that the one before left in the store."""
    rows = q._evaluations(spark, sf_dir).select("rule_id", "ts", "seq", "status", "clears", "delay_seconds")
    files_at, marks, store = shared_path(spark, "evaluations"), shared_path(spark, "stream"), Store(spark, shared_path(spark, "alarms"))
    span = rows.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    cuts = [span["a"] + (span["b"] - span["a"]) * i / 4 for i in range(4)] if span["a"] else []
    for i, low in enumerate(cuts):
        part = rows.where(F.col("ts") >= F.lit(low).cast("timestamp_ntz"))
        part = part.where(F.col("ts") < F.lit(cuts[i + 1]).cast("timestamp_ntz")) if i < 3 else part
        part.coalesce(1).write.mode("append").parquet(files_at)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(files_at)
    stream.writeStream.foreachBatch(lifecycle_sink(store.root)).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return store.table("alarm_transitions")


@query("s AS (SELECT count(*) AS checked FROM (SELECT DISTINCT point_id FROM point_samples)) SELECT s.checked, (SELECT count(*) FROM (SELECT * FROM point_samples QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY ingest_seq DESC) = 1) l WHERE quality = 'STALE' OR received_timestamp + INTERVAL 6 HOUR < TIMESTAMP '2024-02-01') AS stale FROM s", "point_samples")
def health_sweep_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sweep over all current values."""
    current = projection.latest(view(spark, sf_dir, "point_samples"))
    stale = ingest.stale_points(current, F.lit("2024-02-01").cast("timestamp_ntz"))
    return current.agg(F.count("*").alias("checked")).crossJoin(stale.agg(F.count("*").alias("stale")))  # of one row each



@query(f"{q._STALE} SELECT point_id, ingest_seq, min(tick) AS tick FROM stale GROUP BY ALL", "points", "point_samples")
def streamed_stale_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All samples as a stream in two micro-batches by arrival; timers tell of what grows stale. Ticks after the last sample are left out, as the sweeps end there."""
    rows = view(spark, sf_dir, "point_samples").select("point_id", "ingest_seq", "ts", "quality", "received_timestamp", "source_timestamp", "stale_after_seconds")
    span = rows.agg(F.date_trunc("day", F.min("ts")).cast("timestamp_ntz").alias("a"), F.max("ts").alias("b"), F.expr("percentile_approx(ingest_seq, 0.5)").alias("half")).first()
    files_at, marks, out = (shared_path(spark, n) for n in ("samples", "stream", "stale"))
    early = F.col("ingest_seq") <= (span["half"] or 0)
    last = spark.sql("SELECT CAST(NULL AS STRING) AS point_id, CAST(-1 AS BIGINT) AS ingest_seq, TIMESTAMP_NTZ '2100-01-01 00:00:00' AS ts, 'GOOD' AS quality, CAST(NULL AS TIMESTAMP_NTZ) AS received_timestamp, TIMESTAMP_NTZ '2100-01-01 00:00:00' AS source_timestamp, CAST(0 AS BIGINT) AS stale_after_seconds")
    for part in (rows.where(early), rows.where(~early), last):  # the last row lets the watermark pass all others
        part.coalesce(1).write.mode("append").parquet(files_at)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, PROVIDER)
    try:
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(files_at)
        found = streaming_stale_points(stream, str(span["a"] or "2024-01-01"), STALE_TICKS, "40 days")
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.schema(found.schema).parquet(out).where(F.col("tick") <= F.lit(span["b"]).cast("timestamp_ntz"))
