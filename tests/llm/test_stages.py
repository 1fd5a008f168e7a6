"""Each stage of the pipeline on odd inputs: clashing names, nulls, repeated rows, empty tables, long texts."""

import pytest
from conftest import rows_of

import corpus_pipeline
from tickwarden.llm import decontaminate, neardup, pii, quality, sharding

SCHEMA = "doc_id long, text string, __dup_node string, __dup_id long, __leak_key string, __pii_key string, __PII_by int, __quality double, x__leak_key string, node string, item string, root string"
PROSE = "the old harbour was quiet that morning and the boats lay still under a pale and even light while gulls turned over the long grey wall"
ITEM = "which of the seven metals melts at the lowest temperature under ordinary pressure in air"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "a", i, "b", "c", 1, 0.5, "d", "e", "f", "g") for i, t in rows], SCHEMA)


def items(spark, rows=((1, ITEM),)):
    return spark.createDataFrame(list(rows), "item_id long, text string")


ROWS = [(1, PROSE), (2, PROSE.upper()), (3, None), (4, ""), (5, f"{PROSE[:60]} {ITEM} indeed"), (5, f"{PROSE[:60]} {ITEM} indeed"), (None, "Mr John Smith wrote to john.smith@mail.example today"), (7, "word " * 60_000)]


def stages(spark, frame):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    return {
        "quality": quality.keep_good(frame, labels),
        "near_duplicates": neardup.one_of_each(frame),
        "decontamination": decontaminate.drop_contaminated(frame, items(spark)),
        "private_data": pii.replace_private_data(frame),
    }


def test_stages_on_odd_rows(spark):
    frame = docs(spark, ROWS)
    got = stages(spark, frame)
    assert all(df.columns == frame.columns for df in got.values())
    kept = {name: rows_of(df.toPandas()) for name, df in got.items()}
    assert kept["quality"] == rows_of(frame.toPandas())  # nothing to learn from: all score 0.5
    ids = sorted((r["doc_id"] for r in got["near_duplicates"].collect()), key=lambda i: (i is None, i))
    assert ids == [1, 3, 5, 7, None]  # null and empty text are one class, and so are texts that differ in case
    assert sorted((r["doc_id"] for r in got["decontamination"].collect()), key=lambda i: (i is None, i)) == [1, 2, 3, 4, 7, None]
    private = got["private_data"].collect()
    assert len(private) == len(ROWS) and {r["__pii_key"] for r in private} == {"c"} and {r["__PII_by"] for r in private} == {1}
    assert not any("Smith" in (r["text"] or "") or "john.smith" in (r["text"] or "") for r in private)
    assert {r["text"] for r in private if r["doc_id"] == 3} == {None}


def test_stages_on_no_rows(spark):
    for df in stages(spark, docs(spark, [])).values():
        assert df.columns == docs(spark, []).columns and df.count() == 0


def test_pipeline_of_an_empty_table(spark, tmp_path):
    for name, schema in {"documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8, 1.0])
def test_sketches_miss_less_than_stated(threshold):
    import math

    for least, m, need in decontaminate.sketch_sizes(threshold):
        missed = sum(math.comb(m, i) * threshold**i * (1 - threshold) ** (m - i) for i in range(need)) if m else 0
        assert missed <= decontaminate.MISS and m <= max(least, 32)


@pytest.mark.parametrize("threshold", [0.3, 0.5])
def test_other_thresholds_are_exact(spark, threshold):
    words = [f"w{i}" for i in range(90)]
    texts = [(i, " ".join(words[: 10 * i]) + " other words here") for i in range(1, 10)]
    found = decontaminate.contaminated(docs(spark, texts), items(spark, [(1, " ".join(words)), (2, " ".join(words[:14]))]), threshold)
    shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    held = {(d, i): len(shingles(t) & shingles(b)) / len(shingles(b)) for d, t in texts for i, b in ((1, " ".join(words)), (2, " ".join(words[:14])))}
    assert {(r["doc_id"], r["item_id"]): r["containment"] for r in found.collect()} == {k: pytest.approx(c) for k, c in held.items() if c >= threshold}


def test_rows_of_one_key_are_spread_and_balanced(spark, monkeypatch):
    """Two thirds of all rows share a key; the cells of its arc stay small, and loads and slots stay exact."""
    monkeypatch.setattr(sharding, "CELL_ROWS", 50)
    rows = [(i if i % 3 == 0 else 1, f"text {i}") for i in range(2000)]
    got = sharding.consistent_hash_shards(docs(spark, rows), shards=5, vnodes=16).collect()
    load = [sum(r["shard"] == s for r in got) for s in range(5)]
    assert max(load) - min(load) <= 1 and all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(load[s])) for s in range(5))
    full = [load[s] == sharding.quotas(len(rows), 5, 0.0)[s] for s in range(5)]
    assert all(full)  # exact quotas: every shard ends full
    moved = sum(r["shard"] != r["first_shard"] for r in got)
    by_first = [sum(r["first_shard"] == s for r in got) for s in range(5)]
    assert moved >= sum(max(0, n - q) for n, q in zip(by_first, sharding.quotas(len(rows), 5, 0.0)))
