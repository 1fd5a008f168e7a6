import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tickwarden.llm import idfiles, packing, sharding
from tickwarden.llm.tokens import Encoder, vocabulary_path

DOCS = "doc_id long, text string, extra string"
ODD = [(5, "ba na na", "x"), (3, None, None), (None, "", "y"), (5, "ba na na", "x"), (7, "Ünï 日本 <|endoftext|> ½²\n\n  don't", ""), (9, "word " * 6000, "")]


def many(spark, n=3000):
    return spark.createDataFrame([(i, f"text number {i % 700} " * (i % 13), None) for i in range(n)], DOCS)


def test_segments_fill_exact_quotas():
    points = sharding.ring_points(8, 16)
    for counts in ([0] * 128, [5] + [0] * 127, [i % 7 for i in range(128)]):
        segments = sharding.plan_segments(points, counts, 8, 0.0)
        held = [sum(e - s for _, s, e, shard, _ in segments if shard == k) for k in range(8)]
        assert sum(held) == sum(counts) and max(held) - min(held) <= 1


def test_slack_moves_fewer_rows_and_bounds_loads():
    points = sharding.ring_points(8, 16)
    counts = [(i * 37) % 50 for i in range(128)]
    moved = {}
    for slack in (0.0, 0.02, 2.0):
        segments = sharding.plan_segments(points, counts, 8, slack)
        moved[slack] = sum(e - s for a, s, e, shard, _ in segments if shard != points[a][1])
        held = [sum(e - s for _, s, e, shard, _ in segments if shard == k) for k in range(8)]
        assert max(held) <= max(sharding.quotas(sum(counts), 8, slack)) and sum(held) == sum(counts)
    assert 0 == moved[2.0] <= moved[0.02] <= moved[0.0] > 0


def test_arcs_cover_the_ring_once():
    rows = sorted(x[1:3] for x in sharding.arc_rows([p for p, _ in sharding.ring_points(3, 5)]))
    assert rows[0][0] == 0 and rows[-1][1] == sharding.RING - 1
    assert all(a[1] + 1 == b[0] for a, b in zip(rows, rows[1:]))


def test_shards(spark):
    got = sharding.consistent_hash_shards(many(spark)).toPandas()
    assert len(got) == 3000 and set(got["shard"]) == set(range(8))
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    sizes = got.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1
    assert (got["shard"] == got["first_shard"]).mean() > 0.9


def walked(ids, shards, vnodes=128):
    """Shard and slot of each row by a walk row by row: in each round every row that has no shard yet tries the next other shard clockwise of its arc, nearer arcs and lower hashes first."""
    import bisect

    import xxhash

    points = sharding.ring_points(shards, vnodes)
    ends = [p for p, _ in points]
    rows = []
    for i in ids:
        h = xxhash.xxh64_intdigest(int(i).to_bytes(8, "little", signed=True), 42)
        signed = h - (1 << 64) if h >> 63 else h
        rows.append((bisect.bisect_left(ends, h >> 32) % len(ends), signed, i))
    rows.sort()
    room = sharding.quotas(len(rows), shards, 0.0)
    held, placed = [0] * shards, {}
    met = {}
    for arc in {a for a, *_ in rows}:
        seen = {}
        for step in range(len(points)):
            seen.setdefault(points[(arc + step) % len(points)][1])
        met[arc] = list(seen)
    for turn in range(shards):
        for arc, _, i in rows:
            if i not in placed and held[s := met[arc][turn]] < room[s]:
                placed[i] = (s, held[s])
                held[s] += 1
    return placed


def test_shards_are_a_walk_row_by_row(spark):
    docs = many(spark, 1500)
    for shards in (3, 8):
        got = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.consistent_hash_shards(docs, shards=shards).collect()}
        assert got == walked(range(1500), shards)


def test_few_rows_move_when_a_shard_joins(spark):
    docs = many(spark, 3000)
    before, after = ({r["doc_id"]: r["shard"] for r in sharding.consistent_hash_shards(docs, shards=n).collect()} for n in (8, 9))
    moved = [i for i in before if before[i] != after[i]]
    assert len(moved) < 3000 * (1 / 9 + 0.12)  # a ninth must go to the new shard; the rest is what exact quotas shift
    assert sum(after[i] == 8 for i in moved) == sum(s == 8 for s in after.values())


def test_shards_of_odd_rows(spark):
    got = sharding.consistent_hash_shards(spark.createDataFrame(ODD, DOCS)).collect()
    assert len(got) == len(ODD)
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in got} == {(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _ in ODD}
    assert sharding.consistent_hash_shards(spark.createDataFrame([], DOCS)).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 2**17 - 1), max_size=300), st.integers(17, 31))
def test_packed_ids_round_trip(ids, bits):
    a = np.array(ids, np.uint32)
    data = idfiles.pack(a, bits)
    assert len(data) == (len(a) * bits + 7) // 8
    assert np.array_equal(idfiles.unpack(data, bits, len(a)), a)


def test_fewest_bits():
    assert [idfiles.bits_for(n) for n in (1, 2, 3, 49408, 65536, 65537)] == [1, 1, 2, 16, 16, 17]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_is_the_library(name):
    e = Encoder(vocabulary_path(name))
    texts = [t for _, t, _ in ODD] + ["It's THE  x\t\ty 12,5 ''s 'LL we'll ", "İstanbul ΣΑΣ", "é é", "a\x1cb\x85c\xa0d", "Straße ǅ ª¹"]
    texts += ["hello <|startoftext|> world", "a<|endoftext|>b", "plain <|ENDOFTEXT|> text"]
    want = [x.ids for x in Tokenizer.from_file(vocabulary_path(name)).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [x.tolist() for x in e.encode(texts)] == want
    assert e.cut is not None


def test_id_files(spark):
    vocabulary, end = vocabulary_path("word_bpe_49k.json"), 2
    manifest = idfiles.write_id_files(spark.createDataFrame(ODD, DOCS), vocabulary, end, files=3)
    got = idfiles.read_id_files(manifest).orderBy("start").collect()
    e = Encoder(vocabulary)
    docs = sorted(((d, t or "") for d, t, _ in ODD), key=lambda x: (x[0] is not None, x[0] or 0, zlib.crc32(x[1].encode())))
    at = 0
    for r, (d, t) in zip(got, docs, strict=True):
        ids = np.append(e.encode([t])[0], end).astype("<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d, at, len(ids), zlib.crc32(ids))
        at += len(ids)
    assert idfiles.read_id_files(idfiles.write_id_files(spark.createDataFrame([], DOCS), vocabulary, end)).count() == 0


def test_reader_finds_any_document(tmp_path):
    ids = [np.arange(n, dtype=np.uint32) % 70_000 for n in (3, 0, 200_000, 1)]
    with open(tmp_path / "x.ids", "wb") as f:
        w = idfiles.Writer(f, 17)
        w.add(np.array([4, 5, 6, 7]), np.zeros(4, bool), ids)
        w.close()
    import pyarrow as pa

    with pa.OSFile(str(tmp_path / "x.ids")) as f:
        r = idfiles.Reader(f)
        for k in (2, 0, 3, 1):
            assert np.array_equal(r.ids(k), ids[k])
    assert (tmp_path / "x.ids").stat().st_size == w.size


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=60))
def test_best_fit_is_brute_force(sizes):
    got = packing.best_fit(sizes, 100)
    room, want = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [r for r in room if r >= sizes[i]]
        if fits:
            k = room.index(min(fits))
            room[k] -= sizes[i]
        else:
            room.append(100 - sizes[i])
        want[i] = None
    fill = np.bincount(got, weights=sizes)
    assert fill.max() <= 100 and sorted(100 - fill) == sorted(room)


def test_cuts():
    assert packing.cut_lengths(5, 2) == [1, 2, 2] and packing.cut_lengths(4, 2) == [2, 2] and packing.cut_lengths(1, 2) == [1]


@pytest.mark.parametrize("group", [40, 5000])
def test_sequences(spark, group):
    vocabulary = vocabulary_path("byte_bpe_50k.json")
    rows = ODD + [(100 + i, "lorem ipsum " * (i % 150), None) for i in range(400)]
    got = packing.best_fit_sequences(spark.createDataFrame(rows, DOCS), vocabulary, 0, 256, group_items=group).toPandas()
    e = Encoder(vocabulary)
    want = []
    for d, t, _ in rows:
        ids, at = np.append(e.encode([t])[0], 0).astype("<u4"), 0
        for n, size in enumerate(packing.cut_lengths(len(ids), 256)):
            want.append((d, n, at, size, zlib.crc32(ids[at : at + size])))
            at += size
    key = lambda x: tuple(-1 if y is None or y != y else int(y) for y in x)
    assert sorted(map(key, got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False))) == sorted(map(key, want))
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["length"].sum() <= 256 and (g["offset"].to_numpy() == np.cumsum(g["length"]) - g["length"]).all()
    least = -(-got["length"].sum() // 256)
    assert got["sequence_id"].nunique() <= least * 1.05 + 1


def test_pieces_that_never_fit_together_end_the_rounds(spark):
    items = spark.range(500).selectExpr("id", "CAST(60 + id % 30 AS INT) AS size")
    got = packing.pack(items, "size", "id", 100, 50).toPandas()
    assert got["bin"].nunique() == 500
    assert packing.pack(items.where("false"), "size", "id", 100, 50).count() == 0
