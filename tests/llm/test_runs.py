"""Runs and Lyndon words against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tickwarden.llm import registry, runs


def lyndon_by_force(codes):
    """Longest j such that codes[i:j] is lower than all its proper suffixes; borders end a word."""
    out = []
    for i, c in enumerate(codes):
        best = 0
        for j in range(i + 1, len(codes) + 1):
            w = codes[i:j]
            if 0 in w:
                break
            if all(w < w[k:] for k in range(1, len(w))):
                best = j - i
        out.append(best if c else 0)
    return out


def runs_by_force(words, least=12):
    found, n = [], len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            part = words[s : i + q]
            if len(part) >= max(least, 2 * q) and not any(all(a == b for a, b in zip(part, part[d:])) for d in range(1, q)):
                found.append((s, len(part), q))
    return sorted(found, key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=24))
def test_lyndon_words(word):
    codes = [0, *word, 0]
    kinds = {c: i for i, c in enumerate(sorted(set(codes)))}
    codes = [kinds[c] for c in codes]
    assert runs.lyndon_lengths(codes) == lyndon_by_force(codes)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(2, 12))
def test_runs(word, least):
    got = runs.find_runs(np.array(word, np.int64), least) if word else np.empty((0, 3))
    assert [tuple(r) for r in got.tolist()] == runs_by_force(word, least)


def test_runs_of_long_words():
    rng = random.Random(5)
    for size, kinds in ((400, 2), (700, 5), (900, 200)):
        word = [rng.randrange(kinds) for _ in range(size)]
        for _ in range(6):
            a, p, m = rng.randrange(size), rng.randrange(1, 60), rng.randrange(10, 300)
            word[a:a] = [word[(a + i % p) % len(word)] for i in range(m)]
        assert [tuple(r) for r in runs.find_runs(np.array(word)).tolist()] == runs_by_force(word)


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = runs_by_force(words)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return {
        "doc_id": doc_id,
        "n_runs": len(found),
        "start": best and best[0],
        "length": best and best[1],
        "period": best and best[2],
        "exponent_milli": best and 1000 * best[1] // best[2],
        "runs_sha256": sha("".join(f"{s},{m},{q}\n" for s, m, q in found)),
        "collapsed_sha256": sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    }


ODD = [None, "", " \t\n", "a", "la " * 11, "la " * 12, " x  y\x1cz " * 9, "no repeats here at all my friend", "ab cd " * 6 + "ab", "x y z " * 5 + "x y " * 7]


def test_query(spark, tmp_path):
    rng = random.Random(3)
    planted = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0][:12]
    rows = list(enumerate(ODD, 1000)) + [(i, " ".join(str(rng.randrange(90)) for _ in range(rng.randrange(1, 300)))) for i in planted] + [(7, "do re " * 300), (7, "do re " * 300)]
    spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, runs string, collapsed string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.queries()["op11_periodic_runs"](spark, str(tmp_path)).collect()
    assert sorted((r.asDict() for r in got), key=str) == sorted((expected(*r) for r in rows), key=str)


def test_query_on_a_table(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    short = [(r.doc_id, r.text) for r in docs.collect() if len(r.text) < 4000]
    spark.createDataFrame(short, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r.asDict() for r in registry.queries()["op11_periodic_runs"](spark, str(tmp_path)).collect()}
    assert len(got) == len(short)
    for r in short:
        assert got[r[0]] == expected(*r)


def test_null_key_and_no_rows(spark):
    frame = spark.createDataFrame([(None, "a b c d " * 4)], "doc_id string, text string")
    row = runs.periodic_runs(frame).first()
    assert (row["doc_id"], row["n_words"], row["collapsed"]) == (None, 16, "a b c d") and [tuple(r) for r in row["runs"]] == [(0, 16, 4)]
    assert runs.digest(runs.periodic_runs(frame.limit(0))).count() == 0


@pytest.mark.parametrize("text", ["tick tock " * 1_000_000, "w" * 10_000_000])
def test_a_text_of_10_mb(spark, text):
    row = runs.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(r) for r in row["runs"]] == ([(0, 2_000_000, 2)] if " " in text else [])
    assert len(row["collapsed"]) == (9 if " " in text else 10_000_000)
