"""Secrets in texts: three known forms, and runs of characters of high entropy.

Candidates are runs of 20 or more of the characters that keys are written in, with at least one
digit. A candidate belongs to a class by its characters (hexadecimal, or letters and digits at
large), and each class has a window and a threshold. The window slides over the candidate one
character at a time: the count of the character that leaves goes down, that of the one that enters
goes up, and the sum of c log2 c follows from those two, so that the entropy
log2(window) - sum / window is known at each place without counting anew. The span runs from the
first window that reaches the threshold to the end of the last one. Candidates on the allow-list
are left out. All of it is Spark expressions on one row; nothing is shuffled.

Spans are counted in code points, end exclusive. Nulls: a null text counts as empty, a null doc_id
stays null. Very long texts are searched whole, in one row of one task. Ties: spans with equal start stand in the order of their kinds. Repeated rows each give a row. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_text

#: The known forms and the least length of what they must hold.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
ASSIGN_VALUE = 6

CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20,}"
#: Well-known strings that look like keys and are none.
ALLOWED = (
    r"(?i)(example|sample|dummy|placeholder|changeme|xxxx)",
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^[0-9+/_=-]+$",
    r"(?i)(0123456789abcdef|abcdefghijklmnop|1234567890123456)",
)
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_mixed")


@dataclass(frozen=True)
class CharacterClass:
    kind: str
    pattern: str
    window: int
    bits: float


CLASSES = (
    CharacterClass("entropy_hex", r"^([0-9a-f]{24,}|[0-9A-F]{24,})$", 24, 3.0),
    CharacterClass("entropy_mixed", r"^(?=.*[A-Za-z]).+$", 20, 3.7),
)
_SPANS = "array<struct<start:int,end:int,kind:int>>"


def _none() -> Column:
    return F.array().cast(_SPANS)


def _spans(parts: Column, matches: Column, keep: Column, kind: int) -> Column:
    """Spans of the matches, from the text between them; keep has a boolean for each."""
    start = F.struct(F.lit(0).alias("at"), _none().alias("found"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["part"])
        end = begin + F.length(x["match"])
        span = F.struct(begin.alias("start"), end.alias("end"), F.lit(kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(x["keep"], F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"))

    items = F.filter(F.arrays_zip(parts.alias("part"), matches.alias("match"), keep.alias("keep")), lambda x: x["match"].isNotNull())
    return F.aggregate(items, start, step, lambda acc: acc["found"])


def _clog(c: Column) -> Column:
    return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))


def hot_windows(candidate: Column, cls: CharacterClass) -> Column:
    """struct(first, last): start of the first and end of the last window that reaches the threshold; null if none does."""
    w = cls.window
    codes = F.transform(F.split(candidate, ""), lambda c: F.ascii(c))
    steps = F.arrays_zip(codes.alias("enters"), F.concat(F.array_repeat(F.lit(-1), w), codes).alias("leaves"))
    start = F.struct(
        F.array_repeat(F.lit(0), 128).alias("counts"), F.lit(0.0).alias("clogs"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last")
    )

    def step(acc: Column, x: Column) -> Column:
        enters, leaves = x["enters"], x["leaves"]
        gone = F.when(leaves >= 0, F.get(acc["counts"], leaves)).otherwise(F.lit(0))
        had = F.get(acc["counts"], enters) - F.when(enters == leaves, F.lit(1)).otherwise(F.lit(0))
        clogs = acc["clogs"] - _clog(gone) + _clog(gone - 1) - _clog(had) + _clog(had + 1)
        n = acc["n"] + 1
        hot = (n >= w) & (F.log2(F.lit(float(w))) - clogs / w >= cls.bits - 1e-9)
        return F.struct(
            F.transform(acc["counts"], lambda c, i: c + F.when(i == enters, 1).otherwise(0) - F.when(i == leaves, 1).otherwise(0)).alias("counts"),
            clogs.alias("clogs"),
            n.alias("n"),
            F.when(hot & acc["first"].isNull(), n - w).otherwise(acc["first"]).alias("first"),
            F.when(hot, n).otherwise(acc["last"]).alias("last"),
        )

    inside = F.filter(steps, lambda x: x["enters"].isNotNull())
    return F.aggregate(inside, start, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))


def _entropy_spans(spans: Column, text: Column, cls: CharacterClass, kind: int, allowed: tuple[str, ...]) -> Column:
    def of(s: Column) -> Column:
        candidate = F.substring(text, s["start"] + 1, s["end"] - s["start"])
        fits = candidate.rlike(cls.pattern)
        for other in CLASSES[: CLASSES.index(cls)]:
            fits = fits & ~candidate.rlike(other.pattern)
        for pattern in allowed:
            fits = fits & ~candidate.rlike(pattern)
        hot = F.when(fits, hot_windows(candidate, cls))
        return F.transform(F.array(hot), lambda h: F.struct((s["start"] + h["first"]).alias("start"), (s["start"] + h["last"]).alias("end"), F.lit(kind).alias("kind")))

    return F.filter(F.flatten(F.transform(spans, of)), lambda x: x["start"].isNotNull())


def _joined(spans: Column) -> Column:
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kind, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, allowed: tuple[str, ...] = ALLOWED, key: str = "doc_id") -> DataFrame:
    """The key and, as arrays of struct(start, end, kind), assign, access, hex and entropy spans of each document."""
    df = docs.select(F.col(key), whole_text().alias("text"))
    forms = (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("candidate", CANDIDATE))
    for name, pattern in forms:
        p = F.lit(pattern)
        cut = F.struct(F.split("text", pattern, -1).alias("parts"), F.regexp_extract_all("text", p, F.lit(0)).alias("matches"), F.regexp_extract_all("text", p, F.lit(2 if name == "assign" else 0)).alias("values"))
        df = df.withColumn(f"cut_{name}", F.when(F.col("text").rlike(pattern), cut))
    for kind, (name, _) in enumerate(forms):
        c = F.col(f"cut_{name}")
        least = ASSIGN_VALUE if name == "assign" else 1
        keep = F.transform(c["values"], lambda v: F.length(v) >= least)  # noqa: B023  called at once
        df = df.withColumn(name, F.when(c.isNotNull(), _spans(c["parts"], c["matches"], keep, kind)).otherwise(_none()))
    entropy = F.concat(*(_entropy_spans(F.col("candidate"), F.col("text"), cls, KINDS.index(cls.kind), allowed) for cls in CLASSES))
    df = df.withColumn("entropy", F.when(F.size("candidate") > 0, entropy).otherwise(_none()))
    return df.select(key, "assign", "access", "hex", "entropy")


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, the hash of the known forms' spans and all spans as text."""
    base = F.array_sort(F.concat("assign", "access", "hex"), _by_start)
    every = F.array_sort(F.concat("assign", "access", "hex", "entropy"), _by_start)
    return found.select(
        key,
        *(F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(every).alias("spans"),
        F.size("entropy").cast("long").alias("n_entropy"),
    )


def _by_start(a: Column, b: Column) -> Column:
    x, y = F.struct(a["start"], a["kind"], a["end"]), F.struct(b["start"], b["kind"], b["end"])
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)
