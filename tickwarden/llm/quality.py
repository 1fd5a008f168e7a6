"""Quality classifier learned from trusted positives and unlabelled text.

A small network maps a text's shape (shares of its bytes, repetition, word and line statistics)
to a score. It minimises the non-negative unbiased risk

    prior * E_P[l(f)] + max(0, E_U[l(-f)] - prior * E_P[l(-f)])

with the sigmoid loss: P are documents labelled good, U are documents whatever their label. The
class prior is estimated by a first network that tells P from U: it is the least ratio of the shares of all documents and of P
above a threshold of its score, with a margin for chance (the best-bin estimate).

The networks learn from at most ``sample`` labelled and ``sample`` unlabelled documents, those with the smallest hash of their
id, one row for each id; the prior and everything else cover all rows. Documents whose crc32(id) is divisible by 5 are held out of
both samples.

Nulls: a null text counts as empty; a null id is held out; a label of null is none, and labels of
one document that differ make no positive. Without positives or text to learn from, every score
is 0.5. Very long texts are read whole, in time and memory of their length. Ties do not matter: a row's score depends on its text alone. An empty table gives no rows. Repeated rows score alike. Other columns pass through
``keep_good``, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import aside, ship, tidy

SAMPLE = 6000
HIDDEN = 24
#: Texts looked at together.
TEXTS = 500
SHAPES = 12
FEATURES = 256 + SHAPES
REJECT_BELOW = 0.3


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(5)) == 0, F.lit(True))


def features(texts: list[str | None]) -> np.ndarray:
    """One row of numbers for each text."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    for i, t in enumerate(texts):
        if not t:
            continue
        data = np.frombuffer(t.encode("utf-8", "replace"), np.uint8)
        out[i, :256] = np.sqrt(np.bincount(data, minlength=256) / len(data))
        words, lines = t.split(), t.split("\n")
        n = max(1, len(words))
        distinct = len(set(words))
        out[i, 256:] = (
            math.log1p(len(t)) / 10,
            math.log1p(len(words)) / 10,
            len(t) / n / 10,
            distinct / n,
            math.log1p(distinct) / math.log1p(n),
            sum(map(str.__eq__, words, words[1:])) / n,
            sum(map(str.isupper, words)) / n,
            sum(map(str.isalpha, words)) / n,
            sum(map(str.istitle, words)) / n,
            math.log1p(len(lines)) / 5,
            len(set(lines)) / len(lines),
            len(data) / len(t) - 1,
        )
    return out


@dataclass
class Network:
    """Two layers over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum(np.clip((x - self.mean) * self.scale, -6, 6) @ self.w1 + self.b1, 0)
        return (h @ self.w2 + self.b2)[:, 0]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def train(p: np.ndarray, u: np.ndarray, slope, steps: int = 500, batch: int = 1024, rate: float = 3e-3, decay: float = 1e-3, seed: int = 1) -> Network:
    """Adam steps on batches of P and U; slope(f of P, f of U) gives the risk's derivatives by f."""
    rng, both = np.random.default_rng(seed), np.concatenate([p, u])
    mean, scale = both.mean(0), 1 / (both.std(0) + 1e-3)
    net = Network(mean, scale, (rng.standard_normal((p.shape[1], HIDDEN)) / math.sqrt(p.shape[1])).astype(np.float32), np.zeros(HIDDEN, np.float32), (rng.standard_normal((HIDDEN, 1)) / math.sqrt(HIDDEN)).astype(np.float32), np.zeros(1, np.float32))
    p, u = (np.clip((x - mean) * scale, -6, 6) for x in (p, u))
    params = [net.w1, net.b1, net.w2, net.b2]
    first, second = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
    for step in range(1, steps + 1):
        x = np.concatenate([p[rng.integers(0, len(p), batch)], u[rng.integers(0, len(u), batch)]])
        h = np.maximum(x @ net.w1 + net.b1, 0)
        f = (h @ net.w2 + net.b2)[:, 0]
        g = np.concatenate(slope(f[:batch], f[batch:])).astype(np.float32)[:, None]
        back = (g @ net.w2.T) * (h > 0)
        for k, d in enumerate((x.T @ back + decay * net.w1, back.sum(0), h.T @ g + decay * net.w2, g.sum(0))):
            first[k] = 0.9 * first[k] + 0.1 * d
            second[k] = 0.999 * second[k] + 0.001 * d * d
            params[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return net


def told_apart(fp: np.ndarray, fu: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slopes of the logistic loss that tells P from U."""
    return -sigmoid(-fp) / len(fp), sigmoid(fu) / len(fu)


def non_negative_risk(prior: float):
    """Slopes of the non-negative risk; where its second part is negative, that part alone is undone."""

    def slope(fp: np.ndarray, fu: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lp, lu = sigmoid(fp), sigmoid(fu)  # the loss of taking them for negatives
        dp, du = lp * (1 - lp) / len(fp), lu * (1 - lu) / len(fu)
        if lu.mean() - prior * lp.mean() >= 0:
            return -2 * prior * dp, du
        return prior * dp, -du

    return slope


def best_bin(qp: np.ndarray, qu: np.ndarray, n_p: int, n_u: int, margin: float = 0.05) -> float:
    """The least ratio of the shares of U and P above a threshold, with a margin for chance."""
    chance = math.sqrt(math.log(4 / margin) / 2 / n_u) + math.sqrt(math.log(4 / margin) / 2 / n_p)
    best = np.argmin((qu + chance) / qp)
    return float(np.clip(qu[best] / qp[best], 0.05, 0.98))


def class_prior(learn: DataFrame, p: np.ndarray, u: np.ndarray) -> float:
    """The share of positives among all texts t of ``learn``: thresholds from the half of P that the first network didn't see."""
    net = train(p[::2], u[::2], told_apart, steps=200)
    sp = np.sort(net(p[1::2]))
    at = np.unique(sp[: int(len(sp) * 0.95) + 1])  # thresholds that keep 5 % of P at least

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(at) + 1, np.int64)
        for b in tidy(batches):
            for i in range(0, b.num_rows, TEXTS):
                n += np.bincount(np.searchsorted(at, net(features(b.column(0).slice(i, TEXTS).to_pylist())), "right"), minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n)], ["bin", "n"])

    got = learn.select("t").mapInArrow(count, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()  # a row for each threshold
    n = np.zeros(len(at) + 1, np.int64)
    n[got.column("bin").to_numpy()] = got.column("n").to_numpy()
    above = n[::-1].cumsum()[::-1][1:]  # rows at or above each threshold
    return best_bin(1 - np.searchsorted(sp, at) / len(sp), above / max(1, n.sum()), len(sp), max(1, int(n.sum())))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, key: str = "doc_id") -> tuple[Network | None, float]:
    """The network and the prior; None if there is nothing to learn from."""
    ship(docs.sparkSession)
    learn = docs.select(F.col(key).alias("k"), F.col("text").cast("string").alias("t")).where(~held_out("k"))
    trusted = labels.groupBy(F.col(key).alias("k")).agg(F.min("quality").alias("low"), F.max("quality").alias("high")).where("low = 1 and high = 1 and k is not null").where(~held_out("k"))
    first = lambda ids, salt: ids.select("k", F.xxhash64(F.lit(salt), "k").alias("h")).distinct().orderBy("h", "k").limit(sample)
    ids = first(trusted.join(learn.select("k").distinct(), "k"), 1).select("k", F.lit(True).alias("p")).unionByName(first(learn, 2).select("k", F.lit(False).alias("p")))
    chosen = learn.join(F.broadcast(ids), "k")  # 2 * sample ids at most

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tidy(batches):
            for i in range(0, b.num_rows, TEXTS):
                part = b.slice(i, TEXTS)
                x = features(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([r.tobytes() for r in x.astype("<f4")], pa.binary())], ["k", "p", "x"])

    shaped = chosen.select(F.col("k").cast("string").alias("k"), "p", "t").mapInArrow(rows, "k string, p boolean, x binary")
    got = shaped.groupBy("p", "k").agg(F.min("x").alias("x")).select("p", "x").toArrow()  # 2 * sample rows of fixed width at most
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), "<f4").reshape(-1, FEATURES)
    is_p = np.array(got.column("p").to_pylist(), bool)
    order = np.lexsort(x.T[::-1][:8])  # whatever order the rows came in
    x, is_p = x[order], is_p[order]
    rng = np.random.default_rng(0)
    p, u = rng.permutation(x[is_p]), rng.permutation(x[~is_p])
    if min(len(p), len(u)) < 4:
        return None, 0.5
    prior = class_prior(learn, p, u)
    return train(p, u, non_negative_risk(prior)), prior


def with_scores(docs: DataFrame, net: Network | None, out: str = "score") -> DataFrame:
    """All columns and the score of each row, from its text alone."""
    ship(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])
    at = docs.columns.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tidy(batches):
            for i in range(0, b.num_rows, TEXTS):
                part = b.slice(i, TEXTS)
                texts = part.column(at).to_pylist()
                s = sigmoid(net(features(texts)).astype(np.float64)) if net else np.full(len(texts), 0.5)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s, pa.float64())], names=schema.names)

    return docs.mapInArrow(score, schema)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = REJECT_BELOW) -> DataFrame:
    """The documents that score the threshold at least, with the columns they came with, whatever their names."""
    net, _ = fit(docs, labels)
    scored = with_scores(aside(docs, "__quality"), net, "__quality").where(F.col("__quality") >= threshold)
    return scored.drop("__quality").toDF(*docs.columns)
