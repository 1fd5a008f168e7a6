"""Names, inferences and checks of register-map imports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as t

#: Register data types and the kinds of points they make.
DATA_TYPES = {
    "analog": "analog",
    "bool": "boolean",
    "boolean": "boolean",
    "bit": "boolean",
    "enum": "enum",
    "float": "analog",
    "float32": "analog",
    "float64": "analog",
    "int16": "analog",
    "int32": "analog",
    "integer": "analog",
    "uint16": "analog",
    "uint32": "analog",
}
#: Equipment types by the beginning of the id, and what follows from the type.
EQUIPMENT_TYPES = {
    "UPS": "UPS",
    "GEN": "Generator",
    "ATS": "ATS",
    "PDU": "PDU",
    "CRAC": "CRAC",
    "CRAH": "CRAH",
    "AHU": "Air Handler",
    "CHW": "Chilled Water Pump",
    "TEMP": "Temperature Sensor",
    "HUM": "Humidity Sensor",
    "MTR": "Electrical Meter",
}
POWER_TYPES = ("UPS", "Generator", "ATS", "PDU", "Electrical Meter")
COOLING_TYPES = ("CRAH", "CRAC", "Air Handler", "Chilled Water Pump")


def device_name(x: Column) -> Column:
    name = F.replace(F.upper(t.text(x)), F.lit(" "), F.lit("-"))
    name = F.regexp_replace(F.regexp_replace(name, "[^A-Z0-9_-]+", "-"), "-+", "-")
    return F.regexp_replace(name, "^[-_]+|[-_]+$", "")


def point_name(x: Column) -> Column:
    name = F.regexp_replace(F.upper(t.text(x)), "[^A-Z0-9]+", "_")
    return F.regexp_replace(F.regexp_replace(name, "_+", "_"), "^_+|_+$", "")


def title_words(x: Column) -> Column:
    """Upper case after every character that is no letter, lower case after a letter."""
    chars = F.split(x, "")
    start = F.struct(F.lit("").alias("s"), F.lit(False).alias("inside"))
    step = lambda acc, c: F.struct(F.concat(acc["s"], F.when(acc["inside"], F.lower(c)).otherwise(F.upper(c))).alias("s"), c.rlike(r"\p{L}").alias("inside"))
    return F.aggregate(chars, start, step, lambda acc: acc["s"])


def display_name(equipment: Column, point: Column) -> Column:
    words = F.replace(title_words(F.replace(point, F.lit("_"), F.lit(" "))), F.lit("Kw"), F.lit("kW"))
    return F.concat(equipment, F.lit(" "), words)


def equipment_type(equipment: Column) -> Column:
    out = None
    for prefix, kind in EQUIPMENT_TYPES.items():
        out = F.when(equipment.startswith(prefix), kind) if out is None else out.when(equipment.startswith(prefix), kind)
    return out.otherwise("Modbus Device")


def source_system(kind: Column) -> Column:
    return F.when(kind.isin(*POWER_TYPES), "EPMS").otherwise("BMS")


def criticality(kind: Column) -> Column:
    return F.when(kind.isin(*POWER_TYPES), "Critical").when(kind.isin(*COOLING_TYPES), "High").otherwise("Medium")


def location(kind: Column) -> Column:
    return (
        F.when(kind.isin("UPS", "ATS", "PDU", "Electrical Meter"), "Electrical Room A")
        .when(kind == "Generator", "Generator Yard")
        .when(kind.isin("CRAH", "CRAC", "Temperature Sensor", "Humidity Sensor"), "Data Hall A")
        .when(kind.isin("Air Handler", "Chilled Water Pump"), "Central Plant")
        .otherwise("Local Simulation")
    )


def point_type(name: Column, data_type: Column) -> Column:
    return F.when((data_type == "boolean") | name.contains("STATUS") | name.contains("STATE") | name.contains("AVAILABLE"), "status").when(name.contains("COMMAND"), "command").otherwise("sensor")


def data_type(x: Column) -> Column:
    known = F.create_map(*(F.lit(v) for kv in DATA_TYPES.items() for v in kv))
    return F.try_element_at(known, F.lower(t.text(x)))


def address(slave: Column, function: Column, register: Column) -> Column:
    return F.format_string("slave_id=%d;function_code=%d;register_address=%d", slave, function, register)
