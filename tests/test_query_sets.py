"""Searches that take every row whose id is divisible by 20, on the real tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvine import queries
from corvine.operators import vectors

DATA = "/root/testdata"


def scores(spark, sf):
    e = spark.read.parquet(f"{DATA}/{sf}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x, labels = np.array([r.vec_id for r in e]), np.array([r.embedding for r in e], np.float64), np.array([r.label for r in e])
    x /= np.linalg.norm(x, axis=1)[:, None]
    asked = ids[ids % 20 == 0]
    return ids, asked, labels, np.round(x[ids % 20 == 0] @ x.T, 6)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
@pytest.mark.parametrize("name", ["ann_ivf", "ann_lsh"])
def test_registered_recall(spark, name, sf):
    ids, asked, _, s = scores(spark, sf)
    want = {(q, i) for q, line in zip(asked.tolist(), s, strict=True) for i in ids[np.lexsort((ids, -line))[:10]].tolist()}
    got = queries.QUERIES[name](spark, f"{DATA}/{sf}").collect()
    assert len({(r.query_id, r.id) for r in got}) == len(got)
    recall = len(want & {(r.query_id, r.id) for r in got}) / len(want)
    print(name, sf, "recall@10", round(recall, 3), "of", len(asked), "queries")
    assert {r.query_id for r in got} == set(asked.tolist()) and recall >= 0.9


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_exact_searches_answer_all_queries(spark, sf):
    ids, asked, labels, s = scores(spark, sf)
    top = lambda line, kept: [(r, i, line[i]) for r, i in enumerate([i for i in np.lexsort((ids, -line)).tolist() if kept[i]][:10], 1)]
    rows = lambda name, *cols: sorted(tuple(r[c] for c in cols) for r in queries.QUERIES[name](spark, f"{DATA}/{sf}").collect())
    want = sorted((q, *x) for q, line in zip(asked.tolist(), s, strict=True) for x in top(line, ids >= 0))
    left = sorted((q, *x) for q, line in zip(asked.tolist(), s, strict=True) for x in top(line, ids % 5 != 0))
    close = lambda got, want: [x[:-1] for x in got] == [x[:-1] for x in want] and np.allclose([x[-1] for x in got], [x[-1] for x in want], atol=2e-6)
    assert close(rows("j8_exact_knn", "query_id", "rank", "id", "score"), want)
    assert close(rows("v6_remove_then_search", "query_id", "rank", "id", "score"), left)
    assert close(rows("l2_multi_project_topk", "query_id", "rank", "id", "label", "score"), [(q, r, i, labels[i], x) for q, r, i, x in want])
    assert close(rows("j1_hit_lookup_with_warning", "query_id", "id", "score"), sorted((q, i, x) for q, _, i, x in want))


def test_searches_by_blocks_and_groups(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 7)
    x = np.random.default_rng(5).normal(size=(90, 8))
    x[10:30] = x[10]
    df = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "id long, v array<double>, label int")
    q = df.where("id < 20").withColumnRenamed("id", "query_id")
    x /= np.linalg.norm(x, axis=1)[:, None]
    s, ids = np.round(x @ x.T, 6), np.arange(90)
    want = [(k, i) for k in range(20) for i in np.lexsort((ids, -s[k]))[:5].tolist()]
    assert [(r.query_id, r.id) for r in vectors.exact(df, q, 5).orderBy("query_id", "rank").collect()] == want
    assert [(r.query_id, r.id) for r in vectors.exact_by_group(df, q, 5, "label").orderBy("query_id", "rank").collect()] == want


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_extremes_of_all_rows(spark, sf, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 40)
    ids, asked, labels, s = scores(spark, sf)
    other, same = asked[:, None] != ids, labels[asked][:, None] == labels
    got = queries.QUERIES["a14_similar_pairs"](spark, f"{DATA}/{sf}").first()
    want = (s[other & same].min(), s[other & ~same].max())
    assert np.allclose((got.least_similar, got.most_dissimilar), want, atol=2e-6) and got.apart == (want[0] > want[1])
