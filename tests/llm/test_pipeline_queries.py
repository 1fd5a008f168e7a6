import sys
from pathlib import Path

import pytest
from conftest import DATA, rows_of

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from tickwarden.llm import oracle, registry  # noqa: E402


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_oracle(spark, oracle, name):
    from tickwarden.llm.oracle import SQL

    got = registry.queries()[name](spark, DATA).toPandas()
    assert rows_of(got) == rows_of(oracle.sql(SQL[name]).df())


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumnRenamed("n_chars", "n_chars")
    columns, rows = docs.columns, docs.count()
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == columns, name
        n = docs.count()
        assert 0 < n <= rows
        rows = n
    out = p.STAGES[-1][1](spark, docs, DATA)
    assert out.select("doc_id").distinct().count() == rows
    assert p.ORACLE_SQL is None and [s for s, _ in p.STAGES] == ["quality", "near_duplicates", "decontamination", "private_data", "packing"]
