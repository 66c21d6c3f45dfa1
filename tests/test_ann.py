"""The written index of vectors: recall, pruned folders, bytes read, edge cases."""

import numpy as np

from quern.operators import ann
from quern.operators import retrieval as rt
from quern.plans.all import QUERIES

SF = "/root/testdata/sf0.01"


def tables(spark, n=3000, centres=30, asked=20, dim=32, spread=0.25, seed=4):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim))
    row = lambda i: (c[i % centres] + spread * rng.normal(size=dim)).tolist()
    chunks = spark.createDataFrame([(i, row(i)) for i in range(n)], "chunk_id long, embedding array<float>").repartition(4)
    return chunks, spark.createDataFrame([(i, row(i % 3)) for i in range(asked)], "query_id long, query_embedding array<float>")


def pairs(df):
    return {(r.query_id, r.chunk_id): r.similarity for r in df.collect()}


def test_recall_and_exact_scores_on_the_given_vectors(spark):
    exact = pairs(QUERIES["ret_01_dense_topk"](spark, SF).filter("position <= 10"))
    got = pairs(QUERIES["ret_02_ann_topk"](spark, SF))
    assert len(set(exact) & set(got)) / len(exact) >= 0.9
    assert all(abs(exact[p] - got[p]) < 2e-6 for p in set(exact) & set(got))


def test_clustered_vectors_are_found_in_few_bytes(spark, tmp_path):
    chunks, asked = tables(spark)
    path = ann.write_index(chunks, str(tmp_path / "i"))
    got, exact = pairs(ann.search(asked, path, 10, share=0.1)), pairs(rt.dense_topk(asked, chunks, 10, -1.0))
    assert len(got) == len(exact) == 200 and len(set(got) & set(exact)) >= 0.95 * 200
    assert all(abs(got[p] - exact[p]) < 1e-5 for p in set(got) & set(exact))
    assert ann.share_of_bytes(asked, path, 10, share=0.1) < 0.5
    everything = pairs(ann.search(asked, path, 10, share=1.1, short=400))
    assert everything.keys() == exact.keys()


def test_only_asked_folders_are_read(spark, tmp_path):
    chunks, asked = tables(spark)
    path = ann.write_index(chunks, str(tmp_path / "i"), cells=30)
    book = ann.Codebook.read(spark, path)
    assert book.cells.shape == (30, 32) and len(book.groups) == 16 and abs(book.shares.sum() - 1) < 1e-9
    plans = []
    one = asked.limit(1)
    rt_top = ann.search(one, path, 5, share=0.01)
    plans.append(rt_top._jdf.queryExecution().executedPlan().toString())
    assert "PartitionFilters: [cell#" in plans[0].replace("isnotnull(", "") or "cell#" in plans[0].split("PartitionFilters: [")[1].split("]")[0]


def test_edges(spark, tmp_path):
    chunk = lambda rows: spark.createDataFrame(rows, "chunk_id long, embedding array<float>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0])], "query_id long, query_embedding array<float>")
    path = ann.write_index(chunk([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0, 0.0]), (5, [0.0, 0.0])]), str(tmp_path / "few"))
    got = ann.search(asked, path, 2, share=1.1).collect()
    assert [(r.chunk_id, r.similarity) for r in sorted(got, key=lambda r: r.position) if r.query_id == 1] == [(1, 1.0), (4, 1.0)]
    assert {r.query_id for r in got} == {1, 3}
    equal = ann.write_index(chunk([(i, [0.5, 0.5]) for i in range(500)]), str(tmp_path / "equal"))
    assert [r.chunk_id for r in sorted(ann.search(asked.limit(1), equal, 3).collect(), key=lambda r: r.position)] == [0, 1, 2]
    assert ann.search(asked.limit(0), path, 2).collect() == []
