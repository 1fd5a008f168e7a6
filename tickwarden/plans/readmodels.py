"""Enriched read models: left joins with the defaults that readers rely on, and their orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..sources.snapshots import shared_path


def ranked(column: str, *values: str) -> Column:
    """The place of a value in a list, those not in it last."""
    out = F.lit(len(values))
    for i, v in reversed(list(enumerate(values))):
        out = F.when(F.col(column) == v, i).otherwise(out)
    return out


def with_equipment(df: DataFrame, equipment: DataFrame, default: str, key: str = "equipment_id") -> DataFrame:
    """Equipment type, location, criticality and system, with a default where the equipment is not in the catalog."""
    e = equipment.select(F.col("equipment").alias(key), "equipment_type", "location", "criticality", F.col("source_system").alias("equipment_source_system"))
    filled = ("equipment_type", "location", "criticality", "equipment_source_system")
    return df.join(e, key, "left").select(*df.columns, *(F.coalesce(c, F.lit(default)).alias(c) for c in filled))


def equipment_inventory(equipment: DataFrame) -> DataFrame:
    return equipment.orderBy("equipment")


def point_dictionary(points: DataFrame, equipment: DataFrame) -> DataFrame:
    return with_equipment(points, equipment, "Unknown").orderBy("equipment_id", "point_name")


def rule_catalog(rules: DataFrame, points: DataFrame, equipment: DataFrame) -> DataFrame:
    """Rules with point and equipment; a missing point leaves nulls, missing equipment is Unknown."""
    p = points.select("point_id", "point_name", "display_name", "equipment_id", F.col("unit").alias("point_unit"))
    return with_equipment(rules.join(p, "point_id", "left"), equipment, "Unknown").orderBy("equipment_id", "point_name", "rule_name")


#: The columns of an evaluation as readers see it; the first names are those of this library.
EVALUATION_NAMES = {"rule_id": "id", "sample_id": "latest_sample_id", "value": "current_value", "status": "evaluation_status"}
EVALUATION_COLUMNS = (
    "id rule_name rule_type enabled severity alarm_message equipment_id equipment_type location point_id point_name display_name data_type unit latest_sample_id current_value quality source source_timestamp "
    "received_timestamp stale_after_seconds overridden out_of_service protocol address operator threshold_value clear_value delay_seconds is_triggered evaluation_status"
).split()


def evaluations_enriched(evaluations: DataFrame, points: DataFrame, equipment: DataFrame) -> DataFrame:
    """Evaluations of rules on current values with point and equipment, ordered by equipment, point and rule name; flags of a missing value are false."""
    p = points.select("point_id", "point_name", "display_name", "equipment_id", "data_type", "unit")
    df = with_equipment(evaluations.drop("unit", "equipment_id").join(p, "point_id", "left"), equipment, "Unknown")
    df = df.withColumn("is_triggered", F.col("status") == "Triggered").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("overridden", "out_of_service")})
    return df.withColumnsRenamed(EVALUATION_NAMES).select(*EVALUATION_COLUMNS).orderBy("equipment_id", "point_name", "rule_name")


def numbered(df: DataFrame, *order: Column | str) -> DataFrame:
    """Rows with their ``place`` in an order, from 1. Places are counted within ranges of the order, and the ranges' sizes added up: no task sees all rows."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    cut = shared_path(df.sparkSession, "places")
    dealt.write.parquet(cut)
    rows = df.sparkSession.read.schema(dealt.schema).parquet(cut)
    part = F.shiftright("__at", 33)
    sizes = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    before = sizes.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))  # a row for each partition
    return rows.withColumn("__part", part).join(F.broadcast(before), "__part").select(*df.columns, (F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("place"))


def scenario_points(updates: DataFrame, points: DataFrame) -> DataFrame:
    """Updates of a scenario with their points; a point that is not known goes by its id."""
    p = points.select("point_id", "point_name", "equipment_id", "unit").withColumn("known", F.lit(True))
    out = updates.join(p, "point_id", "left")
    blank = {c: F.coalesce(c, F.lit("")) for c in ("equipment_id", "unit")}
    return out.withColumns({"point_name": F.coalesce("point_name", "point_id"), "known": F.coalesce("known", F.lit(False)), **blank}).orderBy("point_id")


def scenarios(updates: DataFrame, points: DataFrame) -> DataFrame:
    """One row for each scenario_id with ``affected_points`` in the order of the updates; a point that is not known goes by its id and has no equipment."""
    p = points.select("point_id", "point_name", "display_name", "equipment_id")
    df = updates.select("scenario_id", "position", "point_id").join(p, "point_id", "left")
    point = F.struct("position", "point_id", *(F.coalesce(c, "point_id").alias(c) for c in ("point_name", "display_name")), F.coalesce("equipment_id", F.lit("")).alias("equipment_id"))
    return df.groupBy("scenario_id").agg(F.array_sort(F.collect_list(point)).alias("p")).select("scenario_id", F.transform("p", lambda x: x.dropFields("position")).alias("affected_points")).orderBy("scenario_id")


def event_view(events: DataFrame, rules: DataFrame, points: DataFrame, equipment: DataFrame, alarms: DataFrame) -> DataFrame:
    """Audit events with rule, point, the equipment that the event itself names and the alarm's message (alarms: id, alarm_message); what is missing is empty. Newest first."""
    df = (
        events.join(rules.select("rule_id", "rule_name"), "rule_id", "left")
        .join(points.select("point_id", "point_name", "display_name"), "point_id", "left")
        .join(equipment.select(F.col("equipment").alias("equipment_id"), "equipment_type", "location"), "equipment_id", "left")
        .join(alarms.select(F.col("id").alias("generated_alarm_id"), F.col("alarm_message").alias("generated_alarm_message")), "generated_alarm_id", "left")
    )
    filled = ("rule_name", "point_name", "display_name", "equipment_type", "location", "generated_alarm_message")
    return df.select(*events.columns, *(F.coalesce(c, F.lit("")).alias(c) for c in filled)).orderBy(F.desc("event_timestamp"), F.desc("id"))


def current_values(latest: DataFrame, points: DataFrame, equipment: DataFrame) -> DataFrame:
    p = points.select("point_id", "point_name", "display_name", "equipment_id", "unit", "data_type")
    return with_equipment(latest.join(p, "point_id", "left"), equipment, "Unknown").orderBy("equipment_id", "point_name")


def events_enriched(events: DataFrame, rules: DataFrame, points: DataFrame, equipment: DataFrame) -> DataFrame:
    """Audit events with rule, point and equipment; whatever is missing is empty text."""
    r = rules.select("rule_id", "rule_name", "severity")
    p = points.select("point_id", "point_name", "equipment_id")
    df = events.join(r, "rule_id", "left").join(p, "point_id", "left")
    df = df.withColumns({c: F.coalesce(c, F.lit("")) for c in ("rule_name", "severity", "point_name", "equipment_id")})
    return with_equipment(df, equipment, "")


def counts_by(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    return df.groupBy(F.col(column).alias("key")).agg(F.count("*").alias(name)).orderBy(F.desc(name), "key")


def filtered_alarms(alarms: DataFrame, state: str | None = None, severity: str | None = None, acknowledged: bool | None = None) -> DataFrame:
    """Alarms by any of three filters; those that are None don't filter."""
    wanted = {"state": state, "severity": severity, "acknowledged": acknowledged}
    for c, v in wanted.items():
        if v is not None:
            alarms = alarms.where(F.col(c) == v)
    return alarms


def actions_ranked(actions: DataFrame, equipment: DataFrame) -> DataFrame:
    return with_equipment(actions, equipment, "").orderBy(ranked("status", "Open", "In Progress"), ranked("priority", "Critical", "High", "Medium"), "due_at", "id")


def nested(parents: DataFrame, members: DataFrame, key: str, *order: str) -> DataFrame:
    """Parents with their members as an ordered array, empty where there are none."""
    columns = [c for c in members.columns if c != key]
    grouped = members.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *(c for c in columns if c not in order)))).alias("members"))
    out = parents.join(grouped, key, "left")
    return out.withColumn("members", F.coalesce("members", F.array().cast(grouped.schema["members"].dataType)))


def first_row(df: DataFrame, *order: Column | str) -> DataFrame:
    """The first row of an order: the active scenario, the latest report."""
    return df.orderBy(*order).limit(1)


def as_json(df: DataFrame) -> DataFrame:
    """One JSON text for each row."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def shift_turnover(turnovers: DataFrame) -> DataFrame:
    """Turnovers with their two semicolon lists as arrays, newest first."""
    return turnovers.withColumns({"watch_item_list": t.semicolon_list(F.col("watch_items")), "open_action_list": t.semicolon_list(F.col("open_actions"))}).orderBy(F.desc("shift_date"), "id")


# --- operations context -------------------------------------------------------------------


def facility_scenarios(scenarios: DataFrame) -> DataFrame:
    return scenarios.orderBy(F.desc("start_time"), "id")


def alarm_correlations(correlations: DataFrame, members: DataFrame, rules: DataFrame, points: DataFrame) -> DataFrame:
    """Correlations with their members, each with its rule's and point's names, empty where they are missing."""
    m = members.select("correlation_id", "id", F.col("alarm_rule_id").alias("rule_id"), "point_id", "equipment_id", "contribution", "evidence")
    m = m.join(rules.select("rule_id", "rule_name", "severity"), "rule_id", "left").join(points.select("point_id", "point_name"), "point_id", "left")
    m = m.withColumns({c: F.coalesce(c, F.lit("")) for c in ("rule_name", "severity", "point_name")}).withColumnRenamed("correlation_id", "parent")
    out = nested(correlations.withColumn("parent", F.col("id")), m.withColumnRenamed("id", "member_id"), "parent", "member_id").drop("parent")
    return out.withColumn("impacted_equipment_list", t.semicolon_list(F.col("impacted_equipment"))).orderBy(F.desc("window_start"), "id")


def incident_timeline(timeline: DataFrame, equipment: DataFrame) -> DataFrame:
    return with_equipment(timeline, equipment, "").orderBy("event_timestamp", "id")


def equipment_out_of_service(rows: DataFrame, equipment: DataFrame) -> DataFrame:
    return with_equipment(rows, equipment, "").orderBy(ranked("status", "Active", "Planned"), "started_at", "id")


def procedure_references(procedures: DataFrame) -> DataFrame:
    return procedures.orderBy(ranked("procedure_type", "EOP", "MOP", "SOP"), "procedure_code", "id")


def reliability_reports(reports: DataFrame) -> DataFrame:
    return reports.orderBy(F.desc("period_end"), "id")


def operations_overview(context: dict[str, DataFrame], equipment: DataFrame, rules: DataFrame, points: DataFrame) -> dict[str, DataFrame]:
    """All context read models by name, the active scenario and the latest report among them."""
    scenarios, reports = facility_scenarios(context["facility_scenarios"]), reliability_reports(context["reliability_reports"])
    return {
        "facility_scenarios": scenarios,
        "active_scenario": scenarios.limit(1),
        "alarm_correlations": alarm_correlations(context["alarm_correlations"], context["alarm_correlation_members"], rules, points),
        "incident_timeline": incident_timeline(context["incident_timeline"], equipment),
        "shift_turnover": shift_turnover(context["shift_turnover"]),
        "equipment_out_of_service": equipment_out_of_service(context["equipment_out_of_service"], equipment),
        "corrective_actions": actions_ranked(context["corrective_actions"], equipment),
        "procedure_references": procedure_references(context["procedure_references"]),
        "reliability_reports": reports,
        "latest_report": reports.limit(1),
    }


def generated_alarms(alarms: DataFrame, rules: DataFrame, points: DataFrame, equipment: DataFrame) -> DataFrame:
    """Alarms with rule, point and the equipment that the alarm itself names, open ones first."""
    r, p = rules.select("rule_id", "rule_name"), points.select("point_id", "point_name", "display_name")
    df = alarms.join(r, "rule_id", "left").join(p, "point_id", "left")
    return with_equipment(df, equipment, "Unknown").orderBy(ranked("state", "ACTIVE", "PENDING", "CLEARED"), F.desc("last_evaluated_at"), "rule_id")


def operational_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """name and n, the number of rows, of each table."""
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def health_projection(latest: DataFrame, points: DataFrame) -> DataFrame:
    """What the next sample's health is compared with: the current facts and the point's equipment, empty where the point is not known."""
    out = latest.join(points.select("point_id", "equipment_id"), "point_id", "left")
    return out.select("point_id", F.coalesce("equipment_id", F.lit("")).alias("equipment_id"), "quality", "overridden", "out_of_service")
