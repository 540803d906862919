"""Every registered query of the subpackage on the small driver tables, and the pipeline."""

import math
import os
from collections import defaultdict

import duckdb
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registered
import corpus_pipeline
from settlespark.llm.encoding import _tokenizer
from settlespark.llm.quality import quality_scores
from settlespark.llm.queries import ORACLES, QUERIES
from tests.llm import test_decontaminate as contaminated
from tests.llm import test_near_dedup as near


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for file in sorted(os.listdir(small)):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{small}/{file}'")
    yield con
    con.close()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def rows(table, columns):
    at = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted((tuple(plain(row[i]) for i in at) for row in table), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, small, duck, name):
    result = QUERIES[name](spark, small)
    want = duck.execute(ORACLES[name])
    assert rows(result.collect(), result.columns) == rows(want.fetchall(), [c[0] for c in want.description])


def test_queries_are_registered():
    assert set(QUERIES) <= set(registered.queries())
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)} | {"pipeline"}
    assert [n for n in QUERIES if n not in ORACLES] == [
        "op2_token_files", "op7_pack_sequences", "op8_token_counts", "op6_quality", "pipeline"]


def test_stages_equal_plain_versions(spark, small):
    """Every stage against a plain statement on its own input."""
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(160).cache()
    columns = docs.columns
    bench = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == [
        "quality classifier", "exact dedup", "near dedup", "benchmark decontamination", "best-fit packing"]

    def run(name, frame):
        out = steps[name](spark, frame, small)
        return [tuple(r) for r in out.collect()], out.columns

    kept, names = run("quality classifier", docs)
    good = {r.doc_id for r in quality_scores(docs).filter("kept").collect()}
    assert names == columns and {r[0] for r in kept} == good and len(kept) == len(good)

    # copies and a benchmark passage, which so few documents may lack
    copies = [(10_000 + i, *r[1:]) for i, r in enumerate(kept[:10])]
    leak = (20_000, bench[0][1] + " " + bench[1][1], *kept[0][2:])
    frame = spark.createDataFrame(kept + copies + [leak], docs.schema)
    unique, names = run("exact dedup", frame)
    best = defaultdict(int)
    for r in kept + copies + [leak]:
        best[r[1]] = max(best[r[1]], r[0])
    assert names == columns and sorted((r[1], r[0]) for r in unique) == sorted(best.items())

    edited = [(30_000 + i, r[1] + " end", *r[2:]) for i, r in enumerate(unique[:8])]
    frame = spark.createDataFrame(unique + edited, docs.schema)
    heads, names = run("near dedup", frame)
    want = {r[2] for r in near.expected([(r[0], r[1]) for r in unique + edited], corpus_pipeline.NEAR_PERCENT)}
    assert names == columns and sorted(r[0] for r in heads) == sorted(want)

    frame = spark.createDataFrame(heads, docs.schema)
    clean, names = run("benchmark decontamination", frame)
    want = {r[0] for r in contaminated.expected([(r[0], r[1]) for r in heads], bench) if not r[-1]}
    assert names == columns and {r[0] for r in clean} == want and 20_000 not in want

    frame = spark.createDataFrame(clean, docs.schema)
    pieces, _ = run("best-fit packing", frame)
    tokenizer = _tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    tokens = {r[0]: len(tokenizer.encode(r[1], add_special_tokens=False).ids) + 1 for r in clean}
    held, filled = defaultdict(int), defaultdict(int)
    for doc_id, _, _, length, _, sequence, _ in pieces:
        held[doc_id] += length
        filled[sequence] += length
    assert dict(held) == tokens and max(filled.values()) <= 4096
    assert len(filled) <= math.ceil(sum(tokens.values()) / 4096) + 1


def test_empty_documents(spark, small, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{small}/{name}.parquet").limit(0 if name == "documents" else 5).write.parquet(
            f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_batches_of_a_stage_are_bounded_in_bytes(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"size": [batch.nbytes], "rows": [batch.num_rows]})

    stage = corpus_pipeline._stage(
        lambda spark, docs, sf_dir: docs.select("text").mapInArrow(sizes, "size long, rows long"))
    docs = spark.range(0, 3000, 1, 1).select("id", F.repeat(F.lit("x"), 10_000).alias("text"))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        found = stage(spark, docs, "").collect()
    finally:
        spark.conf.set(key, before)
    assert sum(r.rows for r in found) == 3000
    assert max(r.size for r in found) < 8 << 20
