"""Domain tables derived from the given tables, in Spark and, for the oracle, in DuckDB SQL.

Points are the events' users; a point's kind (analog, boolean, enum), its rule and its equipment follow from its
number. More points than equipment exist, so that defaults are met.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TICK_SECONDS = 43_200
STALE_SECONDS = 21_600

#: One expression text for both dialects, where it can be.
_EQUIPMENT = """
SELECT CAST(s_suppkey AS {string}) AS equipment,
       CASE s_suppkey % 6 WHEN 0 THEN 'UPS' WHEN 1 THEN 'Generator' WHEN 2 THEN 'PDU' WHEN 3 THEN 'CRAH' WHEN 4 THEN 'CRAC' ELSE 'Chiller' END AS equipment_type,
       COALESCE(n_name, '') AS location,
       CASE WHEN s_acctbal >= 5000 THEN 'Critical' WHEN s_acctbal >= 0 THEN 'High' ELSE 'Medium' END AS criticality,
       COALESCE(r_name, '') AS source_system,
       s_name AS notes
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
"""
_POINTS = """
SELECT concat('PT-', CAST(u AS {string})) AS point_id, CAST(u AS {string}) AS equipment_id,
       concat('POINT_', CAST(u AS {string})) AS point_name, concat('Point ', CAST(u AS {string})) AS display_name,
       CASE u % 3 WHEN 0 THEN 'sensor' ELSE 'status' END AS point_type,
       CASE u % 3 WHEN 0 THEN 'analog' WHEN 1 THEN 'boolean' ELSE 'enum' END AS data_type,
       CASE WHEN u % 3 = 0 THEN 'kW' ELSE '' END AS unit,
       CASE WHEN u % 7 = 0 THEN 'modbus' ELSE '' END AS protocol,
       CASE WHEN u % 7 = 0 THEN concat('slave_id=', CAST(u % 247 + 1 AS {string}), ';function_code=3;register_address=', CAST(u AS {string})) ELSE '' END AS address,
       u
FROM (SELECT DISTINCT user_id AS u FROM events WHERE user_id IS NOT NULL) AS users
"""
_RULES = """
SELECT concat('R-', CAST(u AS {string})) AS rule_id, concat('PT-', CAST(u AS {string})) AS point_id, concat('Rule ', CAST(u AS {string})) AS rule_name,
       CASE u % 3 WHEN 0 THEN 'analog_limit' WHEN 1 THEN 'boolean_state' ELSE 'enum_match' END AS rule_type,
       CASE u % 3 WHEN 0 THEN CASE WHEN u % 2 = 0 THEN '>' ELSE '<' END ELSE '==' END AS operator,
       CASE u % 3 WHEN 0 THEN CASE WHEN u % 2 = 0 THEN '60' ELSE '10' END WHEN 1 THEN 'on' ELSE 'ERROR' END AS threshold_value,
       CASE u % 3 WHEN 0 THEN CASE WHEN u % 2 = 0 THEN '40' ELSE '20' END ELSE '' END AS clear_value,
       CASE u % 5 WHEN 0 THEN 'Critical' WHEN 1 THEN 'Critical' WHEN 4 THEN 'Info' ELSE 'Warning' END AS severity,
       concat('Alarm of point ', CAST(u AS {string})) AS alarm_message,
       u % 11 <> 0 AS enabled, CAST((u % 4) * 3600 AS BIGINT) AS delay_seconds, u
FROM (SELECT DISTINCT user_id AS u FROM events WHERE user_id IS NOT NULL) AS users
"""
_SAMPLES = """
SELECT event_id AS ingest_seq, concat('PT-', CAST(user_id AS {string})) AS point_id, ts,
       CASE user_id % 3 WHEN 0 THEN CAST(CAST(value AS DECIMAL(18, 2)) AS {string})
                        WHEN 1 THEN CASE WHEN k % 2 = 0 THEN 'true' ELSE 'off' END
                        ELSE event_type END AS value,
       CASE event_id % 10 WHEN 0 THEN 'BAD' WHEN 1 THEN 'UNCERTAIN' WHEN 2 THEN 'STALE' WHEN 3 THEN 'UNKNOWN' ELSE 'GOOD' END AS quality,
       event_id % 17 = 0 AS overridden, event_id % 19 = 0 AS out_of_service,
       CAST(21600 AS BIGINT) AS stale_after_seconds, 'SIMULATED' AS source, ts AS received_timestamp, ts AS source_timestamp
FROM (SELECT *, CAST({k} AS BIGINT) AS k FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL) AS e
"""
_LOG = """
SELECT o_orderpriority AS severity, o_orderstatus AS source, CAST(l_suppkey AS {string}) AS equipment, l_linestatus AS status, l_shipdate AS ts, l_orderkey, l_linenumber
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""
_ACTIONS = """
SELECT CAST(o_orderkey AS {string}) AS id, CAST(o_custkey % 150 AS {string}) AS equipment_id,
       CASE o_orderstatus WHEN 'O' THEN 'Open' WHEN 'P' THEN 'In Progress' ELSE 'Complete' END AS status,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'Critical' WHEN '2-HIGH' THEN 'High' WHEN '3-MEDIUM' THEN 'Medium' ELSE 'Low' END AS priority,
       o_orderdate AS due_at,
       concat('inspect;  ', o_orderpriority, ';;', o_orderstatus, ' ; ') AS steps
FROM orders
"""
_REGISTERS = """
SELECT p_partkey + 2 AS row_number, concat(p_brand, ' ', CASE p_partkey % 4 WHEN 0 THEN 'ups' WHEN 1 THEN 'crah' WHEN 2 THEN 'mtr' ELSE 'x' END) AS raw_name,
       CASE p_partkey % 5 WHEN 0 THEN concat('UPS ', p_brand) WHEN 1 THEN concat('crah_', p_brand) WHEN 2 THEN concat('MTR  ', p_brand) WHEN 3 THEN p_brand ELSE concat('PT-', CAST(p_partkey % 50 AS {string})) END AS device_name,
       CAST(p_size * 6 AS {string}) AS slave_id, CAST(p_partkey % 6 AS {string}) AS function_code,
       CAST(p_partkey * 37 % 70000 AS {string}) AS register_address,
       p_name AS point_name, CASE p_partkey % 7 WHEN 0 THEN 'bool' WHEN 1 THEN 'Float32' WHEN 2 THEN 'enum' WHEN 3 THEN 'text' ELSE 'uint16' END AS data_type,
       CASE WHEN p_partkey % 29 = 0 THEN 'n/a' WHEN p_partkey % 31 = 0 THEN 'much' ELSE '0.1' END AS scale,
       'kW' AS unit, p_type AS description
FROM part
"""

VIEWS = {"equipment": _EQUIPMENT, "points": _POINTS, "alarm_rules": _RULES, "point_samples": _SAMPLES, "alarm_log": _LOG, "corrective_actions": _ACTIONS, "register_map": _REGISTERS}
TABLES = {
    "equipment": ("supplier", "nation", "region"),
    "points": ("events",),
    "alarm_rules": ("events",),
    "point_samples": ("events",),
    "alarm_log": ("lineitem", "orders"),
    "corrective_actions": ("orders",),
    "register_map": ("part",),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table over the Parquet tables of a folder."""
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES[name]}
    text = VIEWS[name].format(string="STRING", k="get_json_object(props, '$.k')")
    for t in frames:  # frames are arguments of the query: {t}
        text = _named(text, t)
    return spark.sql(text, **frames)


def _named(text: str, table: str) -> str:
    for word in ("FROM", "JOIN"):
        text = text.replace(f"{word} {table} ", f"{word} {{{table}}} AS {table} ").replace(f"{word} {table}\n", f"{word} {{{table}}} AS {table}\n")
    return text


def duckdb(*names: str) -> str:
    """The domain tables as common table expressions for DuckDB."""
    k = "json_extract_string(props, '$.k')"
    return ",\n".join(f"{n} AS ({VIEWS[n].format(string='VARCHAR', k=k)})" for n in names)
