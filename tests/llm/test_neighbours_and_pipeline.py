"""Nearest neighbours against brute force; the pipeline stage by stage."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loamcube.llm import hilbert_ann, mixing, simhash
from loamcube.llm._shared import connected_components
from tests.llm.conftest import with_clashes

SF = "/root/testdata/sf0.001"


def test_hilbert_numbers_are_a_walk_through_the_grid():
    for axes, bits in ((2, 3), (3, 2)):
        side = 2**bits
        grid = np.stack(np.meshgrid(*[np.arange(side)] * axes, indexing="ij"), -1).reshape(-1, axes)
        order = hilbert_ann.hilbert_numbers(grid, bits).astype(int)
        assert sorted(order) == list(range(side**axes))
        steps = np.abs(np.diff(grid[np.argsort(order)], axis=0)).sum(axis=1)
        assert (steps == 1).all()


def brute(vectors, queries, k=5):
    out = {}
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], float)
    norms = np.sqrt((x * x).sum(axis=1))
    for q in queries:
        s = x @ np.array(vectors[q], float) / (norms * np.sqrt(np.dot(vectors[q], vectors[q])))
        order = sorted((-round(float(v), 12), i) for v, i in zip(s, ids, strict=True) if i != q)[:k]
        out[q] = [i for _, i in order]
    return out


@pytest.mark.parametrize(("sf", "every", "recall"), [("sf0.001", 10, 0.9), ("sf0.1", 20, 0.98)])
def test_recall_on_the_table(spark, sf, every, recall):
    """At sf0.1 a window doesn't cover the table: some 4 of 5 vectors are compared."""
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    vectors = {r.vec_id: list(r.embedding) for r in df.collect()}
    queries = [i for i in vectors if i % every == 0]
    got = hilbert_ann.nearest(df, df.where(f"vec_id % {every} = 0")).collect()
    want = brute(vectors, queries)
    found = {q: [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] for q in queries}
    assert sum(len(set(found[q]) & set(want[q])) for q in queries) >= recall * 5 * len(queries)
    assert all(r.score <= 1 + 1e-12 for r in got) and all(len(v) == 5 for v in found.values())


def test_copies_ties_and_bad_vectors(spark):
    hot = [1.0, 2.0, 3.0]
    rows = [(i, hot) for i in range(100, 140)] + [(1, [2.0, 4.0, 6.0]), (2, [1.0, 2.0, 2.9]), (50, None), (51, [0.0, 0.0, 0.0]), (52, [1.0, None, 1.0]), (53, [float("nan"), 1.0, 1.0]), (54, [1.0]), (None, hot), (55, [float("inf"), 0.0, 0.0]), (2, [1.0, 2.0, 2.9])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = hilbert_ann.nearest(with_clashes(df, "curve", "rep", "score"), df.where("vec_id in (2, 50, 100, 139)")).collect()
    by = {q: [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] for q in (2, 50, 100, 139)}
    assert by == {2: [1, 100, 101, 102, 103], 50: [], 100: [1, 101, 102, 103, 104], 139: [1, 100, 101, 102, 103]}
    assert hilbert_ann.nearest(df.limit(0)).count() == 0
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in hilbert_ann.nearest(few).orderBy("query_id").collect()] == [(1, 1, 2, 0.0), (2, 1, 1, 0.0)]


def test_vectors_of_any_finite_size(spark):
    rows = [(1, [1.0, 0.0]), (2, [1e200, 1e200]), (3, [0.0, 5e-324]), (4, [-1e308, 1e-308]), (5, [3e-200, 4e-200])]
    got = hilbert_ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("query_id = 1").orderBy("rank").collect()
    assert [r.vec_id for r in got] == [2, 5, 3, 4]
    assert [r.score for r in got] == pytest.approx([0.5**0.5, 0.6, 0.0, -1.0])


@pytest.mark.parametrize("few", [1000, 0])
def test_components_of_a_chain_and_a_star(spark, few):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), few=few).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 140), 100)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        before = {r.doc_id: r for r in docs.collect()}
        kept = {r.doc_id: r for r in out.collect()}
        assert set(kept) <= set(before) and len(kept) > 0.5 * len(before), name
        if name != "source_mixing":
            assert out.columns == docs.columns
        if name == "simhash_near_dedup":
            assert len({" ".join(r.text.split()) for r in kept.values()}) == len(kept)
            groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, scheme=simhash.NEAR).collect()}
            assert set(kept) == set(groups.values())
        elif name == "suffix_array_dedup":
            strings = {}
            for r in kept.values():
                if r.text == before[r.doc_id].text:
                    b = r.text.encode()
                    for s in {b[i : i + 200] for i in range(len(b) - 199)}:
                        strings[s] = strings.get(s, 0) + 1
            assert not strings or max(strings.values()) == 1
            assert all(r.n_chars == len(r.text) for r in kept.values() if r.text != before[r.doc_id].text)
        elif name == "source_mixing":
            mixed = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
            assert {i: r.taken for i, r in kept.items()} == {i: t for i, t in mixed.items() if t}
        docs = spark.createDataFrame(out.select(docs.columns).collect(), docs.schema)


def test_pipeline_of_edge_rows(spark, tmp_path):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "words here " * 40, "en", None, 440), (3, "tie " * 60, "en", "a", 240), (3, "tie " * 60, "en", "a", 240), (4, "long word soup " * 20_000, "de", "b", 300_000)]
    for t, df in (("documents", spark.createDataFrame(rows, schema)), *((t, spark.read.parquet(f"{SF}/{t}.parquet").limit(0)) for t in ("labels", "benchmark"))):
        df.write.parquet(str(tmp_path / f"{t}.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.where(F.col("taken") <= 0).count() == 0
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
