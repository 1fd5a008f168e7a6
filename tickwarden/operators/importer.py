"""Register-map imports: normalisation with issues, duplicates, conflicts, preview and commit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import registers as g
from ..functions import text as t
from ..sources.snapshots import Conflict, Transaction
from .events import ACTOR, audit_events, details

#: The fields that a row must have (a unit may be blank), their ranges, and what imported equipment says of itself.
REQUIRED = ("device_name", "slave_id", "function_code", "register_address", "point_name", "data_type", "scale", "description")
RANGES = {"slave_id": (1, 247), "function_code": (1, 4), "register_address": (0, 65535)}
PROTOCOL = "modbus"
NOTES = "Imported from static Modbus register map"


def issue(fails: Column, field: str, message: Column | str) -> Column:
    said = F.lit(message) if isinstance(message, str) else message
    return F.when(fails, F.struct(F.lit(field).alias("field"), said.alias("message")))


def issues_of(*checks: Column) -> Column:
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def normalised(raw: DataFrame) -> DataFrame:
    """Import rows with their issues; raw rows carry row_number."""
    ints = {f: t.ranged_integer(F.col(f), *RANGES[f]) for f in RANGES}
    scale, kind = t.number(F.col("scale")), g.data_type(F.col("data_type"))
    checks = [issue(~t.has_value(F.col(f)), f, f"Missing required field: {f}") for f in REQUIRED]
    for f, (low, high) in RANGES.items():
        checks.append(issue(t.has_value(F.col(f)) & ints[f].isNull(), f, f"{f} must be an integer from {low} to {high}"))
    checks.append(issue(t.has_value(F.col("scale")) & scale.isNull(), "scale", "scale must be a number"))
    checks.append(issue(t.has_value(F.col("data_type")) & kind.isNull(), "data_type", f"data_type must be one of: {', '.join(sorted(g.DATA_TYPES))}"))
    df = raw.select(
        "row_number",
        g.device_name(F.col("device_name")).alias("equipment_id"),
        g.point_name(F.col("point_name")).alias("point_name"),
        *(c.alias(f) for f, c in ints.items()),
        scale.alias("scale"),
        kind.alias("data_type"),
        F.lower(t.text(F.col("data_type"))).alias("register_data_type"),
        t.text(F.col("unit")).alias("unit"),
        t.text(F.col("description")).alias("description"),
        issues_of(*checks).alias("issues"),
    )
    kind_of = g.equipment_type(F.col("equipment_id"))
    df = df.withColumn("equipment_type", kind_of).withColumn("point_id", F.concat_ws("_", "equipment_id", "point_name"))
    complete = (F.size("issues") == 0) & (F.col("equipment_id") != "") & (F.col("point_name") != "")
    return df.select(
        "*",
        g.source_system(F.col("equipment_type")).alias("source_system"),
        g.criticality(F.col("equipment_type")).alias("criticality"),
        g.location(F.col("equipment_type")).alias("location"),
        g.display_name(F.col("equipment_id"), F.col("point_name")).alias("display_name"),
        g.point_type(F.col("point_name"), F.col("data_type")).alias("point_type"),
        F.lit(PROTOCOL).alias("protocol"),
        g.address(F.col("slave_id"), F.col("function_code"), F.col("register_address")).alias("address"),
        complete.alias("complete"),
    )


def with_duplicates(rows: DataFrame) -> DataFrame:
    """Complete rows with first_point_row and first_address_row: the first row of the file with the same key."""
    done = rows.where("complete")
    point = done.groupBy("point_id").agg(F.min("row_number").alias("first_point_row"))
    address = done.groupBy("address").agg(F.min("row_number").alias("first_address_row"))
    return done.join(point, "point_id").join(address, "address")


def _twice() -> Column:
    """Issues of a row of with_duplicates whose point or address an earlier row has."""
    point, address = F.col("first_point_row"), F.col("first_address_row")
    named = F.concat(F.lit("Duplicate point_name in import: "), "point_name", F.lit(" also appears on row "), point)
    placed = F.concat(F.lit("Duplicate Modbus address tuple in import: "), F.replace(F.col("address"), F.lit(";"), F.lit(", ")), F.lit(" also appears on row "), address)
    at = lambda fails, field, first, said: F.when(fails, F.struct(F.lit(field).alias("field"), first.alias("first_row"), said.alias("message")))
    return issues_of(at(F.col("row_number") > point, "point_name", point, named), at(F.col("row_number") > address, "register_address", address, placed))


def duplicate_issues(rows: DataFrame) -> DataFrame:
    """Issues of rows whose point or address an earlier row has: row_number, point_id, address, field, first_row, message."""
    return with_duplicates(rows).select("row_number", "point_id", "address", F.explode(_twice()).alias("i")).select("row_number", "point_id", "address", "i.*")


def with_conflicts(rows: DataFrame, points: DataFrame) -> DataFrame:
    """Complete rows with their action and what conflicts with the catalog (point_id, protocol, address)."""
    known = points.select("point_id", F.coalesce("protocol", F.lit("")).alias("known_protocol"), F.coalesce("address", F.lit("")).alias("known_address"))
    placed = known.where("known_protocol <> '' and known_address <> ''")
    owners = placed.groupBy(F.col("known_protocol").alias("protocol"), F.col("known_address").alias("address")).agg(F.max("point_id").alias("owner"))
    df = rows.where("complete").join(known.withColumn("exists", F.lit(True)), "point_id", "left").join(owners, ["protocol", "address"], "left")
    exists, has_metadata = F.coalesce("exists", F.lit(False)), (F.col("known_protocol") != "") & (F.col("known_address") != "")
    same = (F.col("known_protocol") == F.col("protocol")) & (F.col("known_address") == F.col("address"))
    action = F.when(~exists, "create_point").when(~has_metadata, "update_point_metadata").when(same, "skip_existing_point").otherwise("create_point")
    return df.select(
        *rows.columns,
        action.alias("action"),
        F.when(F.col("owner") != F.col("point_id"), F.col("owner")).alias("address_owner"),
        (exists & has_metadata & ~same).alias("metadata_conflict"),
        (exists & (~has_metadata | same)).alias("warns"),
    )


def _clashes() -> Column:
    """Errors of a row of with_conflicts."""
    return issues_of(
        issue(F.col("address_owner").isNotNull(), "register_address", F.concat(F.lit("Modbus address conflicts with existing point "), "address_owner")),
        issue(F.col("metadata_conflict"), "point_name", F.concat(F.lit("Point already exists with different protocol/address metadata: "), "point_id")),
    )


def _warnings() -> Column:
    same, fill = F.col("action") == "skip_existing_point", F.col("action") == "update_point_metadata"
    return issues_of(
        issue(same, "point_name", F.concat(F.lit("Point already has matching Modbus metadata: "), "point_id")),
        issue(fill, "point_name", F.concat(F.lit("Existing point will be updated with Modbus metadata: "), "point_id")),
    )


def flagged(rows: DataFrame, points: DataFrame, equipment: DataFrame) -> DataFrame:
    """All rows of a file with all that is said of them: ``issues``, ``errors`` (those and duplicates and conflicts), ``warnings``, ``action`` and ``new_equipment``; one pass over the file and its keys."""
    owned = equipment.select(F.col("equipment").alias("__equipment"))
    done = with_conflicts(with_duplicates(rows), points).join(owned, F.col("equipment_id") == F.col("__equipment"), "left")
    plain = lambda c: F.transform(c, lambda x: F.struct(x["field"].alias("field"), x["message"].alias("message")))
    more = done.select("row_number", "action", F.col("__equipment").isNull().alias("new_equipment"), F.concat(plain(_twice()), _clashes()).alias("later"), _warnings().alias("warnings"))
    out = rows.join(more, "row_number", "left")
    none = F.array().cast("array<struct<field:string,message:string>>")
    return out.withColumns({"errors": F.concat("issues", F.coalesce("later", none)), "warnings": F.coalesce("warnings", none)}).drop("later")


def row_errors(rows: DataFrame, points: DataFrame, equipment: DataFrame) -> DataFrame:
    """row_number, field and message of every error of an import."""
    return flagged(rows, points, equipment).select("row_number", F.explode("errors").alias("e")).select("row_number", "e.field", "e.message")


def preview_summary(rows: DataFrame, points: DataFrame, equipment: DataFrame) -> DataFrame:
    """One row of counters, by one aggregate."""
    wrong, done = F.size("errors") > 0, F.col("action").isNotNull()
    counts = {"create_point": "would_create_point_count", "update_point_metadata": "would_update_point_count", "skip_existing_point": "would_skip_point_count"}
    none = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))  # noqa: E731  of an empty file
    return flagged(rows, points, equipment).agg(
        F.count("*").alias("total_rows"),
        F.count_if(done).alias("parsed_rows"),
        F.count_if(~wrong).alias("valid_rows"),
        none(F.sum(F.size("errors")).cast("bigint")).alias("error_count"),
        none(F.sum(F.size("warnings")).cast("bigint")).alias("warning_count"),
        F.countDistinct(F.when(done & F.col("new_equipment"), F.col("equipment_id"))).alias("would_create_equipment_count"),
        *(F.count_if(F.col("action") == a).alias(n) for a, n in counts.items()),
    )


def without_errors(rows: DataFrame, points: DataFrame, equipment: DataFrame) -> DataFrame:
    """The rows that nothing is wrong with: what a file must consist of to be committed."""
    return flagged(rows, points, equipment).where(F.size("errors") == 0).select(*rows.columns)


def committed(rows: DataFrame, points: DataFrame, equipment: DataFrame, at: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(equipment to add, points to add, points whose blank metadata are filled) of a file without errors."""
    clash = with_conflicts(rows, points)
    first = F.min_by(F.struct("equipment_type", "location", "criticality", "source_system"), "row_number")
    new_equipment = clash.groupBy(F.col("equipment_id").alias("equipment")).agg(first.alias("e")).join(equipment.select("equipment"), "equipment", "left_anti").select("equipment", "e.*", F.lit(NOTES).alias("notes"))
    columns = ["point_id", "equipment_id", "point_name", "display_name", "point_type", "data_type", "unit", "source_system", "description", "protocol", "address"]
    new_points = clash.where("action = 'create_point'").select(*columns, at.alias("created_at"), at.alias("updated_at"))
    fill = clash.where("action = 'update_point_metadata'").select("point_id", *(F.col(c).alias(f"new_{c}") for c in ("unit", "description", "source_system", "protocol", "address")))
    put = {c: F.when(F.col(c) == "", F.col(f"new_{c}")).otherwise(F.col(c)) for c in ("unit", "description", "source_system")}
    put |= {"protocol": F.col("new_protocol"), "address": F.col("new_address"), "updated_at": at}
    updated = points.join(fill, "point_id").select(*(put.get(c, F.col(c)).alias(c) for c in points.columns))
    return new_equipment, new_points, updated


def commit_event(rows: DataFrame, points: DataFrame, equipment: DataFrame, at: Column, csv_path: str) -> DataFrame:
    """MODBUS_IMPORT_COMMITTED of a file without errors, on the point of its first row; none for a file without rows."""
    df = flagged(rows, points, equipment).agg(
        F.min_by(F.struct("point_id", "equipment_id"), "row_number").alias("first"),
        F.count("*").alias("row_count"),
        F.countDistinct(F.when(F.col("new_equipment"), F.col("equipment_id"))).alias("created_equipment_count"),
        *(F.count_if(F.col("action") == a).alias(n) for a, n in (("create_point", "created_point_count"), ("update_point_metadata", "updated_point_count"), ("skip_existing_point", "skipped_row_count"))),
    )
    counts = ("row_count", "created_equipment_count", "created_point_count", "updated_point_count", "skipped_row_count")
    return audit_events(
        df.where("row_count > 0"),
        {
            "point_id": F.col("first.point_id"),
            "equipment_id": F.col("first.equipment_id"),
            "event_type": "MODBUS_IMPORT_COMMITTED",
            "event_timestamp": at,
            "acknowledged_by": ACTOR,
            "message": "Static Modbus register map imported into equipment and point records",
            "details_json": details({"csv_path": F.lit(csv_path), **{c: F.col(c) for c in counts}}),
        },
    )


def commit_import(tables: Transaction, rows: DataFrame, at: Column, csv_path: str) -> dict[str, int | bool]:
    """Put the rows of a file into ``equipment`` and ``points`` and its event into ``alarm_events``, and commit; or change nothing, where any row has an error.

    The file is validated against the version of the catalog that the transaction began with. If another one was committed meanwhile, Conflict is raised; begin anew then.
    """
    rows = tables.staged(rows)
    points, equipment = tables.table("points"), tables.table("equipment")
    summary = preview_summary(rows, points, equipment).first().asDict()
    if summary["error_count"]:
        return {**summary, "committed": False, "version": tables.base.version}
    new_equipment, new_points, updated = committed(rows, points, equipment, at)
    event = tables.staged(commit_event(rows, points, equipment, at, csv_path))
    changed = tables.staged(new_points.unionByName(updated, allowMissingColumns=True).select(*points.columns))
    tables.insert_missing("equipment", new_equipment.select(*(c for c in equipment.columns if c in new_equipment.columns)), "equipment")
    tables.upsert("points", changed, "point_id")
    tables.append("alarm_events", event)
    return {**summary, "committed": True, "version": tables.commit()}


__all__ = ["Conflict", "commit_event", "commit_import", "committed", "duplicate_issues", "flagged", "normalised", "preview_summary", "row_errors", "with_conflicts", "with_duplicates", "without_errors"]
