"""Runs of words: stretches of a text that repeat themselves with a period.

A run is a stretch of words with smallest period q, at least two periods and ``least`` words long, that
no neighbouring word extends. For either order of the words, the longest Lyndon word that begins at each place
comes from Baier's grouping, the first phase of a suffix sorter: places are grouped by their word; the
groups are taken from the highest down, and each adds its context to the nearest place before each of
its members that stands in a lower group, once for each member; places with the same new context
become a group above the one that they came from. When a group's turn comes, its context is the
longest Lyndon word of its members; no suffix is ever sorted. Every run has a Lyndon root in one of the
two orders, so each of those words is stretched to the left and to the right by longest common extensions,
and what is long enough is a run. Extensions come from exact names of all stretches of 2^k words.

Words of a run stand in stretches of ceil(least / 2) words that come again in the run. Stretches that don't come again
are left out before the grouping; that drops no run. All of it works on one text at a time, in tasks, without a shuffle.

Nulls: a null text has no words; a null key stays null. Empty texts have no runs. Very long texts: a text is worked on whole,
by one task, in memory in proportion to its length. Ties: runs with equal start are ordered by period. Repeated rows each give a row. An
empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, tidy, whole_text

#: Words of a run at least.
LEAST = 12
#: Bytes of text that a task works on at once, unless one text is longer.
SLICE_BYTES = 4 << 20

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def lyndon_lengths(codes: list[int]) -> list[int]:
    """The length of the longest Lyndon word that begins at each place, by Baier's grouping.

    Codes are 0, 1, 2 and so on without gaps; the first is 0. A 0 is a border: it is lower than all else, and its own length is given as 0.
    """
    found, group = [0] * len(codes), list(codes)
    members: list[list[int]] = [[] for _ in range(max(codes) + 1)]
    for i, c in enumerate(codes):
        members[c].append(i)
    context = [1] * len(members)
    down, up = [g - 1 for g in range(len(members))], [g + 1 for g in range(len(members))]
    before = [i - 1 for i in range(len(codes))]  # the nearest place before that is not known to be done
    g = len(members) - 1
    while g > 0:
        own = [i for i in members[g] if group[i] == g]
        members[g] = own
        added = context[g]
        for i in own:
            found[i], group[i] = added, -1
        times: dict[int, int] = {}
        for i in own:
            j = before[i]
            if group[j] < 0:
                path = [i]
                while group[j] < 0:
                    path.append(j)
                    j = before[j]
                for k in path:
                    before[k] = j
            times[j] = times.get(j, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for j, k in times.items():
            if group[j]:
                moved.setdefault((group[j], k), []).append(j)
        for (old, k), places in sorted(moved.items(), reverse=True) if len(moved) > 1 else moved.items():  # the last put in stands lowest, next to the old group
            new = len(members)
            for j in places:
                group[j] = new
            members.append(places)
            context.append(context[old] + k * added)
            above = up[old]
            down.append(old)
            up.append(above)
            up[old] = new
            down[above] = new
        g = down[g]
    return found


class Names:
    """Exact names of all stretches of 2^k words; equal stretches have equal names."""

    def __init__(self, words: np.ndarray, longest: int) -> None:
        self.levels = [words.astype(np.int32)]
        while (size := 1 << len(self.levels)) <= min(longest, len(words)):
            last = self.levels[-1].astype(np.int64)
            pairs = (last[: len(words) - size + 1] << 32) | last[size // 2 : len(words) - size // 2 + 1]
            self.levels.append(np.unique(pairs, return_inverse=True)[1].astype(np.int32))

    def _common(self, a: np.ndarray, b: np.ndarray, backwards: bool) -> np.ndarray:
        """How many words are the same from a and b (a < b) on, or up to them."""
        length = np.zeros(len(a), np.int64)
        for k in reversed(range(len(self.levels))):
            names, size = self.levels[k], 1 << k
            x, y = (a - length - size + 1, b - length - size + 1) if backwards else (a + length, b + length)
            inside = x >= 0 if backwards else y < len(names)
            same = np.zeros(len(a), bool)
            same[inside] = names[x[inside]] == names[y[inside]]
            length += same * size
        return length

    def right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._common(a, b, False)

    def left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._common(a, b, True)


def _repeated(words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Borders (first, end) of the stretches whose every word stands in ``size`` words that come again in the same stretch.

    Stretches are hashed: two different ones with one hash keep words that could go, and lose none.
    """
    rng = np.random.default_rng(1)
    n = len(words) - size + 1
    if n <= 1:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    mixed = rng.integers(0, 1 << 63, int(words.max()) + 1, np.uint64)[words]
    hashes = np.zeros(n, np.uint64)
    for j in range(size):
        hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + mixed[j : j + n]
    at, stretch = np.arange(n), np.zeros(n, np.int64)
    firsts = ends = np.empty(0, np.int64)
    for _ in range(8):  # each pass looks for repeats within what the one before it kept
        order = np.lexsort((hashes[at], stretch)) if len(firsts) else np.argsort(hashes[at])
        h, s = hashes[at][order], stretch[order]
        equal = (h[1:] == h[:-1]) & (s[1:] == s[:-1])
        again = np.zeros(len(at), bool)
        again[order[1:]] |= equal
        again[order[:-1]] |= equal
        kept = at[again]
        edges = np.zeros(len(words) + 1, np.int64)
        np.add.at(edges, kept, 1)
        np.add.at(edges, kept + size, -1)
        covered = np.concatenate([[0], (np.cumsum(edges[:-1]) > 0).astype(np.int8), [0]])
        step = np.diff(covered)
        firsts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        if len(kept) == len(at) or not len(kept):
            break
        at, stretch = kept, np.searchsorted(firsts, kept, "right") - 1
    return firsts, ends


def find_runs(words: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start and period; the words are numbers from 0."""
    firsts, ends = _repeated(words, (least + 1) // 2)
    if not len(firsts):
        return np.empty((0, 3), np.int64)
    lens = ends - firsts
    total = int(lens.sum()) + len(lens) + 1
    begin = np.cumsum(lens + 1) - lens  # a border stands before each stretch and after the last
    place = np.repeat(firsts - begin, lens)
    inside = np.ones(total, bool)
    inside[begin - 1] = inside[-1] = False
    where = np.flatnonzero(inside)
    codes = np.zeros(total, np.int64)
    codes[where] = np.unique(words[where + place], return_inverse=True)[1] + 1
    kinds = int(codes.max())
    apart = codes.copy()
    apart[~inside] = kinds + 1 + np.arange(total - len(where))  # borders are equal to nothing
    names = Names(apart, int(lens.max()))
    up = np.array(lyndon_lengths(codes.tolist()), np.int64)
    down = np.array(lyndon_lengths(np.where(inside, kinds + 1 - codes, 0).tolist()), np.int64)
    roots = np.unique(np.concatenate([np.stack([where, x[where]], 1) for x in (up, down)]), axis=0)
    at, period = roots[:, 0], roots[:, 1]
    start = at - names.left(at - 1, at + period - 1)
    length = at + period + names.right(at, at + period) - start
    long = length >= np.maximum(least, 2 * period)
    found = np.unique(np.stack([start, period, length], 1)[long], axis=0)
    shift = np.zeros(total, np.int64)
    shift[where] = place
    return np.stack([found[:, 0] + shift[found[:, 0]], found[:, 2], found[:, 1]], 1)


def _numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts as numbers, with a number that comes once after each text; and where each text begins."""
    known: dict[bytes, int] = {}
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(lens + 1) - lens - 1
    out = np.empty(int(lens.sum()) + len(texts), np.int64)
    for b, words in zip(begin.tolist(), texts, strict=True):
        out[b : b + len(words)] = [known.setdefault(w, len(known)) for w in words]
    out[begin + lens] = len(known) + np.arange(len(texts))
    return out, begin


def _collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words joined by a space, of each run its first period only."""
    if len(runs):
        edges = np.zeros(len(words) + 1, np.int64)
        np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
        np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0)]
    return b" ".join(words)


def _slices(texts: list[bytes]) -> Iterator[list[bytes]]:
    some: list[bytes] = []
    size = 0
    for t in texts:
        if some and size + len(t) > SLICE_BYTES:
            yield some
            some, size = [], 0
        some.append(t)
        size += len(t)
    if some:
        yield some


def periodic_runs(docs: DataFrame, least: int = LEAST, key: str = "doc_id") -> DataFrame:
    """The key, ``n_words``, ``runs`` (start, length, period in words) by start and period, and ``collapsed``: the text's words joined by a space, of each run its first period only.

    Words are what white space (space, and code points 9 to 13) parts.
    """
    ship(docs.sparkSession)
    df = docs.select(F.col(key), whole_text().alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            for texts in _slices(batch.column(1).cast(pa.binary()).to_pylist()):
                split = [t.split() for t in texts]  # of bytes: at those six characters and no others
                numbers, begin = _numbered(split)
                found = find_runs(numbers, least)
                text_of = np.searchsorted(begin, found[:, 0], "right") - 1
                found[:, 0] -= begin[text_of]
                cut = np.searchsorted(text_of, np.arange(len(split) + 1))
                runs = pa.StructArray.from_arrays([pa.array(found[:, c]) for c in range(3)], fields=list(_RUN))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(split)),
                        pa.array([len(w) for w in split], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(cut, pa.int32()), runs),
                        pa.array([_collapsed(w, found[cut[i] : cut[i + 1]]) for i, w in enumerate(split)], pa.binary()).cast(pa.string()),
                    ],
                    ["key", "n_words", "runs", "collapsed"],
                )
                first += len(split)

    kind = df.schema[0].dataType.simpleString()
    out = df.mapInArrow(lambda batches: tidy(work(batches)), f"key {kind}, n_words bigint, runs {RUNS}, collapsed string")
    return out.withColumnRenamed("key", key)


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The number of runs, the longest one (the first of equals, then the one with the smallest period), and hashes of all runs and of the collapsed text."""

    def line(r: Column) -> Column:
        return F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))

    best = F.get(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))), F.lit(0))
    length = -F.col("best.less")
    return found.withColumn("best", best).select(
        key,
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        length.alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * -best.less div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
