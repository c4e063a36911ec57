"""Work of op4_near_dup and the pipeline's near_duplicates on one large family of near copies."""

import random
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from corvine.llm import near_dup


def family(size, seed=1):
    """A text of 150 words and copies of it with up to 15 words replaced by new ones."""
    rng = random.Random(seed)
    base = [f"b{k}" for k in range(150)]
    out = [base]
    for _ in range(size - 1):
        own = list(base)
        for _ in range(rng.randrange(16)):
            own[rng.randrange(150)] = f"q{rng.randrange(10**9)}"
        out.append(own)
    return out


def plain(texts):
    """Each text's smallest reachable one, from all pairs."""
    sets = [{tuple(w[k : k + 3]) for k in range(len(w) - 2)} for w in texts]
    often = Counter(x for s in sets for x in s)
    place = {x: k for k, x in enumerate(x for x, n in often.items() if n > 1)}
    has = np.zeros((len(sets), len(place)), np.float32)
    for k, s in enumerate(sets):
        has[k, [place[x] for x in s if x in place]] = 1
    n, common = np.array([len(s) for s in sets]), np.rint(has @ has.T).astype(np.int64)
    linked = 100 * common >= 85 * (n[:, None] + n - common)
    out = [-1] * len(sets)
    for first in range(len(sets)):
        todo = [first] if out[first] < 0 else []
        while todo:
            k = todo.pop()
            if out[k] < 0:
                out[k] = first
                todo += [int(j) for j in np.flatnonzero(linked[k]) if out[j] < 0]
    return out


def test_a_family_gives_pairs_in_proportion(spark, monkeypatch):
    """The text that the others are copies of is the hub of its buckets, so no pairs of
    its copies with each other are left for the prefix filter."""
    rows, real = defaultdict(int), near_dup.written

    def written(df, label, folder=None):
        out = real(df, label, folder)
        rows[label] += out.count() if label in ("pairs", "crossing") else 0
        return out

    monkeypatch.setattr(near_dup, "written", written)
    texts = family(2000)
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(df, 3, 85).collect()}
    assert [got[k] for k in range(len(texts))] == plain(texts)
    assert rows["crossing"] <= len(texts) and rows["pairs"] <= 50 * len(texts)


def test_pairs_are_joined_once(spark, monkeypatch):
    """Hot nodes are counted in the table of pairs; counting them in its join with texts
    or sketches would compute that join again for each count."""
    seen, real = [], near_dup._hot

    def hot(rows, key, most):
        seen.append((key, "Join" in rows._jdf.queryExecution().analyzed().toString()))
        return real(rows, key, most)

    monkeypatch.setattr(near_dup, "_hot", hot)
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(family(60))], "doc_id long, text string")
    assert near_dup.near_duplicates(df, 3, 85).count() == 60
    assert {x for x in seen if x[0] in "ab"} == {("a", False), ("b", False)}


def test_the_pipelines_stage_joins_pairs_once(spark, monkeypatch):
    seen, real = [], near_dup._hot

    def hot(rows, key, most):
        seen.append((key, "Join" in rows._jdf.queryExecution().analyzed().toString()))
        return real(rows, key, most)

    monkeypatch.setattr(near_dup, "_hot", hot)
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(family(60))], "doc_id long, text string")
    assert 0 < corpus_pipeline.near_duplicates(spark, df, "").count() < 60
    assert set(seen) == {("a", False), ("b", False)}
