"""Parsing and normalising of text fields as Spark expressions.

All fields arrive as text. Blank means null, empty, or one of a few words, in either case and
with white space around. Numbers follow Python's float() on ASCII text; whatever doesn't parse is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
BLANKS = ("", "null", "none", "n/a")
TRUE_WORDS = ("true", "1", "yes", "on")
FALSE_WORDS = ("false", "0", "no", "off")
QUALITIES = ("GOOD", "UNCERTAIN", "BAD", "STALE")
SOURCES = ("SIMULATED", "BMS", "EPMS", "PLC", "DCIM", "MANUAL", "SCENARIO")
SEVERITIES = ("Critical", "Warning", "Info")
RULE_TYPES = ("analog_limit", "boolean_state", "enum_match")
ANALOG_OPERATORS = (">", ">=", "<", "<=")
MATCH_OPERATORS = ("==", "!=")
DEFAULT_STALE_AFTER = 300
_NUMBER = r"^[+-]?(([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+(_[0-9]+)*)?|inf|infinity|nan)$"
_ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?)?$"


def text(x: Column) -> Column:
    """Stripped of all white space at the ends; null is empty."""
    return F.regexp_replace(F.coalesce(x.cast("string"), F.lit("")), r"^\s+|\s+$", "")


def has_value(x: Column) -> Column:
    return ~F.lower(text(x)).isin(*BLANKS)


def number(x: Column) -> Column:
    """A double or null; words for infinity and not-a-number count."""
    t = F.lower(text(x))
    bare = F.regexp_replace(t, "^[+-]", "")
    value = (
        F.when(bare == "nan", F.lit(float("nan")))
        .when(bare.isin("inf", "infinity"), F.when(t.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))
        .otherwise(F.replace(t, F.lit("_"), F.lit("")).try_cast("double"))
    )
    return F.when(has_value(x) & t.rlike("(?i)" + _NUMBER), value)


def boolean(x: Column) -> Column:
    t = F.lower(text(x))
    return F.when(t.isin(*TRUE_WORDS), True).when(t.isin(*FALSE_WORDS), False)


def flag(x: Column) -> Column:
    """False for null, blank and the words for it; any other text is true."""
    t = F.lower(text(x))
    return ~(t.isin(*FALSE_WORDS) | (t == ""))


def replay_flag(x: Column) -> Column:
    return F.lower(text(x)).isin(*TRUE_WORDS)


def enabled(x: Column) -> Column:
    """True, false, or null for what isn't one of the words."""
    t = F.lower(text(x))
    return F.when(t.isin("true", "1", "yes"), True).when(t.isin("false", "0", "no"), False)


def timestamp(x: Column) -> Column:
    """ISO text without a zone; anything else is null."""
    t = text(x)
    return F.when(t.rlike(_ISO), F.replace(t, F.lit("T"), F.lit(" ")).try_cast("timestamp_ntz"))


def whole_seconds(x: Column, default: int) -> Column:
    """Truncated seconds; the default for what is blank or no finite number."""
    n = number(x)
    return F.when(n.isNull() | F.isnan(n) | (F.abs(n) > 9e15), F.lit(default)).otherwise(n.cast("long"))


def stale_after(x: Column) -> Column:
    return F.greatest(whole_seconds(x, DEFAULT_STALE_AFTER), F.lit(0))


def delay_seconds(x: Column) -> Column:
    return whole_seconds(x, 0)


def non_negative_integer(x: Column) -> Column:
    """A long; blank is 0; fractions, negatives, words and booleans are null."""
    t = text(x)
    n = F.when(t.rlike(r"^[+]?[0-9]+(\.0+)?$"), F.regexp_replace(t, r"\.0+$", "").try_cast("bigint"))
    return F.when(~has_value(x), F.lit(0)).otherwise(n)


def ranged_integer(x: Column, low: int, high: int) -> Column:
    n = F.when(text(x).rlike(r"^[+-]?[0-9]+$"), text(x).try_cast("bigint"))
    return F.when(n.between(low, high), n)


def ingest_quality(x: Column) -> Column:
    """One of QUALITIES, or null for an invalid word."""
    q = F.upper(text(x))
    q = F.when(q == "UNKNOWN", "UNCERTAIN").otherwise(q)
    return F.when(q.isin(*QUALITIES), q)


def loader_quality(x: Column) -> Column:
    q = F.upper(text(x))
    return F.when(~has_value(x) | (q == "UNKNOWN"), "UNCERTAIN").otherwise(q)


def value_source(x: Column) -> Column:
    s = F.upper(text(x))
    return F.when(s.isin(*SOURCES), s)


def severity(x: Column) -> Column:
    t = F.lower(text(x))
    out = F.lit(None).cast("string")
    for s in SEVERITIES:
        out = F.when(t == s.lower(), s).otherwise(out)
    return out


def optional_text(x: Column) -> Column:
    return F.when(has_value(x), text(x)).otherwise("")


def optional_number(x: Column) -> Column:
    return number(x)


def semicolon_list(x: Column) -> Column:
    items = F.transform(F.split(F.coalesce(x, F.lit("")), ";"), text)
    return F.filter(items, lambda i: i != "")


def unit_or(unit: Column, fallback: Column) -> Column:
    return F.coalesce(F.nullif(unit, F.lit("")), fallback)


def operators_for(rule_type: Column) -> Column:
    return F.when(rule_type == "analog_limit", F.array(*map(F.lit, ANALOG_OPERATORS))).when(rule_type.isin("boolean_state", "enum_match"), F.array(*map(F.lit, MATCH_OPERATORS)))


def python_bool(x: Column) -> Column:
    return F.initcap(x.cast("string"))


def json_object(fields: dict[str, Column]) -> Column:
    """Compact JSON with sorted keys; nulls are written."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def stable_id(prefix: str, *parts: Column) -> Column:
    """A readable id and twelve hexadecimal digits of a hash of the natural key."""
    key = F.concat_ws("|", *(p.cast("string") for p in parts))
    return F.concat(F.lit(f"{prefix}-"), parts[0].cast("string"), F.lit("-"), F.substring(F.sha2(key, 256), 1, 12))
