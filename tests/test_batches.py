"""Batches and products that stay small, however wide rows are."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators import embed as E
from tidemark.operators import pruned as PN
from tidemark.operators import retrieve as V
from tidemark.plans import queries as Q
from tidemark.session import BATCH_BYTES, BATCH_KEY, small_batches
from tidemark.sources import writers


def test_batches_of_wide_rows_are_small(spark):
    rows = spark.range(0, 4000, 1, 1).select(F.array_repeat(F.col("id").cast("double"), 384).alias("vector"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "size": [batch.nbytes]})

    before = spark.conf.get(BATCH_KEY)
    with small_batches(spark, 1 << 20):
        got = rows.mapInArrow(sizes, "n long, size long").collect()
    assert spark.conf.get(BATCH_KEY) == before
    assert sum(r.n for r in got) == 4000 and max(r.size for r in got) < 1 << 21
    with small_batches(spark, 1 << 30):
        assert spark.conf.get(BATCH_KEY) == before


@pytest.mark.parametrize("given,held", [("64m", 1 << 22), ("2m", 1 << 21), ("1000", 1000)])
def test_a_given_bound_is_read_with_its_unit(spark, given, held):
    before = spark.conf.get(BATCH_KEY)
    spark.conf.set(BATCH_KEY, given)
    try:
        with small_batches(spark):
            assert spark.conf.get(BATCH_KEY) == f"{held}b"
        assert spark.conf.get(BATCH_KEY) == given
    finally:
        spark.conf.set(BATCH_KEY, before)


@pytest.mark.parametrize("name", ["citations", "evidence_digest", "hybrid_evidence"])
def test_evidence_is_searched_in_small_batches(spark, monkeypatch, name):
    seen = []
    for module, work in ((V, "best_vectors"), (V, "best_lexical"), (writers, "index")):
        def spy(*given, _work=getattr(module, work), **more):
            seen.append(spark.conf.get(BATCH_KEY))
            return _work(*given, **more)

        monkeypatch.setattr(module, work, spy)
    before = spark.conf.get(BATCH_KEY)
    Q.QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    assert len(seen) == 3 and all(int(s.rstrip("b")) <= BATCH_BYTES for s in seen)
    assert spark.conf.get(BATCH_KEY) == before


def test_products_with_centres_stay_few():
    rng = np.random.default_rng(3)
    x, centres = PN._unit(rng.normal(size=(8000, 8)))[0], PN._unit(rng.normal(size=(2048, 8)))[0]
    tracemalloc.start()
    of, near = PN._nearest(x, centres)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # all products at once are 131 MB
    assert most < 20e6
    products = x @ centres.T
    assert np.allclose(near, products.max(axis=1), atol=1e-6)
    assert (near == np.einsum("ij,ij->i", x, centres[of])).all()


def test_blocks_of_vectors_are_opened_as_they_were(spark):
    rng = np.random.default_rng(5)
    rows = [(f"c{i:03d}", "ab"[i % 2], v.tolist()) for i, v in enumerate(rng.normal(size=(700, 6)))] + [("c000", "a", [0.0] * 6), (None, "a", [1.0] * 6)]
    index = PN.VectorIndex(spark.createDataFrame(rows, "chunk_id string, cell string, vector array<double>"))
    # one binary a block, where vectors made rows of thousands of doubles
    assert dict(index.blocks.dtypes)["packed"] == "binary"
    got = []
    for r in index.blocks.collect():
        block = pa.StructArray.from_arrays([pa.array([r.rows], pa.int32()), pa.array([r.ids], pa.list_(pa.string())), pa.array([bytes(r.packed)])], ["rows", "ids", "packed"])
        got += [(c["chunk_id"], r.cell, c["vector"]) for c in PN._opened(block, index.dim).to_pylist()]
    assert sorted(got, key=str) == sorted(rows, key=str)


def test_vectors_are_made_where_chunks_were_dealt(spark, tmp_path, monkeypatch):
    chunks = spark.createDataFrame([(f"c{i}", "market_law", "all" if i % 2 else None, f"text {i}") for i in range(40)], "chunk_id string, source_category string, platform string, text string")
    writers.index(chunks, str(tmp_path / "after"), "", lambda rows: E.with_vectors(rows, embedder=Q.MD5))
    writers.index(E.with_vectors(chunks, embedder=Q.MD5), str(tmp_path / "before"), "")
    after, before = (writers.read_index(spark, str(tmp_path / n)).select("chunk_id", "platform_key", "vector").collect() for n in ("after", "before"))
    assert sorted(after) == sorted(before) and len(after) == 40
