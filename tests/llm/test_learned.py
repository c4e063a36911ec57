"""Held-out accuracy of what is learned on driver tables, and learning and
scoring against plain versions on small ones."""

import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from corvine.llm import language, quality, toxicity
from corvine.llm.common import run_folder
from corvine.llm.language import op5_language
from corvine.llm.quality import op6_quality
from corvine.llm.toxicity import op10_toxicity

SF = "/root/testdata/sf0.01"
LARGE = "/root/testdata/sf0.1"
tables = pytest.mark.skipif(not os.path.isdir(LARGE), reason="no driver tables")


@tables
def test_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    held = op5_language(spark, SF).where("held_out").join(docs, "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in held)


@tables
def test_quality(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = op6_quality(spark, SF).where("held_out").join(labels, "doc_id").collect()
    assert sum(r.kept == (r.quality == 1) for r in held) >= 0.9 * len(held)


@tables
def test_toxicity(spark):
    """At sf0.1: the labels of sf0.01 hold 45 toxic training texts in four languages,
    too few to learn the terms of any but English."""
    labels = spark.read.parquet(f"{LARGE}/labels.parquet").select("doc_id", "toxic")
    held = op10_toxicity(spark, LARGE).where("held_out").join(labels, "doc_id").collect()
    toxic, clean = [r.score for r in held if r.toxic == 1], [r.score for r in held if r.toxic == 0]
    assert sum(x >= 0.5 for x in toxic) >= 0.9 * len(toxic)
    assert sum(x >= 0.5 for x in clean) <= 0.01 * len(clean)
    assert sum(a > b for a in toxic for b in clean) >= 0.95 * len(toxic) * len(clean)


def plain_grams(text):
    """The n-grams of a text: letters lower-cased, all else one blank."""
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    run = " " + " ".join(words) + " " if words else ""
    return [run[k : k + w] for w in (3, 4) for k in range(len(run) - w + 1)]


def gram_hash(gram):
    packed = 0
    for k, c in enumerate(gram):
        x = ord(c) if c != " " else 0
        packed |= x << 21 * k if k < 3 else (x << 43) % 2**64 ^ x >> 3
    x = (packed + (len(gram) << 57)) % 2**64
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> shift) * factor % 2**64
    return x ^ x >> 31


def test_language_filters_equal_sets(spark):
    """The Bloom table against plain sets, and every decision against plain counts."""
    rng = random.Random(5)
    words = {"aa": ["the", "and", "house", "Straße", "x"], "bb": ["und", "haus", "straße", "der", "x"], "cc": ["日本語", "ところ", "x", "é"]}
    rows = [(k, " 1, ".join(rng.choice(words[lang]) for _ in range(rng.randint(1, 25))), lang) for k in range(240) for lang in [rng.choice(["aa", "bb", "cc"])]]
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "12 !", None), (903, "the haus", None)]
    folder = run_folder(spark, "language")
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{folder}/documents.parquet")
    taught = [r for r in rows if r[2] and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 4 != 2]
    langs = [x for x, _ in sorted(Counter(r[2] for r in taught).items(), key=lambda p: (-p[1], p[0]))]
    counts = {x: Counter(g for r in taught if r[2] == x for g in plain_grams(r[1])) for x in langs}
    share = {x: {g: n / sum(c.values()) for g, n in c.items()} for x, c in counts.items()}
    rows_of_table = 1 << language.TABLE_BITS
    bits = {x: set() for x in langs}
    places = lambda g: [(gram_hash(g) + k * ((gram_hash(g) >> 32) | 1)) % rows_of_table for k in range(3)]
    for x in langs:
        for g, n in counts[x].items():
            if n > 1 and share[x][g] >= 0.5 * max(s.get(g, 0) for s in share.values()):
                bits[x].update(places(g))
    for r in op5_language(spark, folder).collect():
        text = next(t for k, t, _ in rows if k == r.doc_id)
        grams = plain_grams(text)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if not grams:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        true = []
        for x in langs:
            false = min((len(bits[x]) / rows_of_table) ** 3, 0.99)
            hits = sum(all(p in bits[x] for p in places(g)) for g in grams)
            true.append(max(0.0, (hits - false * len(grams)) / (1 - false)))
        prior = [math.log(sum(t[2] == x for t in taught) / len(taught)) for x in langs]
        best = max(range(len(langs)), key=lambda k: true[k] + 1e-9 * prior[k])
        assert r.lang_pred == langs[best]
        assert abs(r.score - (1 / sum((t / true[best]) ** 4 for t in true) if true[best] else 1 / len(langs))) < 1e-9


def test_ordinal_gradient_and_grades(spark):
    """The gradient against differences, scores against the plain formula, and
    grades of any numbers in their order."""
    rng = np.random.default_rng(4)
    n = 30
    text, slot = np.repeat(np.arange(n), 3), rng.integers(0, 20, 3 * n)
    args = (text, slot, rng.random(3 * n), rng.normal(size=(n, quality.SHAPES)), rng.integers(0, 4, n), np.full(n, 1 / n), 0.01)
    theta = np.concatenate((0.3 * rng.normal(size=quality.SLOTS + quality.SHAPES), [-1.0, 0.2, -0.4]))
    _, grad = quality.loss(theta, *args)
    for k in (*range(20), *range(quality.SLOTS, len(theta))):
        step = np.zeros_like(theta)
        step[k] = 1e-5
        assert abs((quality.loss(theta + step, *args)[0] - quality.loss(theta - step, *args)[0]) / 2e-5 - grad[k]) < 1e-6

    words = {1.0: ["bad"], 2.0: ["fair"], 3.5: ["good"]}
    py = random.Random(1)
    rows = [(k, g, " ".join(py.choice(words[g] + ["the", "a"]) for _ in range(12))) for k in range(300) for g in [py.choice([1.0, 2.0, 3.5])]]
    docs = spark.createDataFrame([(k, t) for k, _, t in rows] + [(0, "again")] * 50, "doc_id long, text string")
    model = quality.learn(docs, spark.createDataFrame([(k, g) for k, g, _ in rows], "doc_id long, grade double"), sample_rows=240)
    assert model.grades == [1.0, 2.0, 3.5] and model.thresholds[0] < model.thresholds[1]
    right = 0
    got = {r.doc_id: r for r in quality.rate(docs.where("text <> 'again'"), model).collect()}
    for k, g, t in rows:
        f = quality.features(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))
        z = sum(float(v) * model.weights[s] for s, v in zip(f[1], f[2], strict=True)) + float(f[3][0] @ model.weights[quality.SLOTS :])
        tail = [1 / (1 + math.exp(c - z)) for c in model.thresholds]
        assert tail[0] >= tail[1] and abs(got[k].tail - tail[1]) < 1e-9
        assert abs(got[k].expected_grade - (1.0 + tail[0] * 1.0 + tail[1] * 1.5)) < 1e-9
        right += min((1.0, 2.0, 3.5), key=lambda x: abs(x - got[k].expected_grade)) == g
    assert right >= 0.95 * len(rows)


def edits(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d = d, [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            d[j] = min(p[j] + 1, d[j - 1] + 1, p[j - 1] + (x != y))
    return d[-1]


def plain_features(text, weights):
    """Hits of a text word by word, each word compared with every term."""
    words = [(m[0], m.start()) for m in re.finditer(r"[^\W\d_]+", (text or "").lower())]
    hits, quoted, plain = [], 0, []
    for i, (w, at) in enumerate(words):
        near = [(t, 0) for t in weights if t == w]
        near = near or [(t, 0) for n in (5, 4) for t in weights if t == f"{w[:n]}*" and len(w) > n][:1]
        near = near or ([(t, 1) for t in sorted(weights) if t[-1] != "*" and len(t) >= 5 and edits(t, w) == 1][:1] if len(w) >= 4 else [])
        if near:
            line = text.lower().rfind("\n", 0, at) + 1
            inside = text[line:at].count('"') % 2 == 1 and '"' in text[at:].split("\n")[0]
            if inside or {"said", "says", "wrote"} & {x for x, _ in words[max(0, i - 3) : i]}:
                quoted += 1
            else:
                plain.append((i, *near[0]))
    dense = max([sum(weights[t] / (1 + e) for j, t, e in plain if i - 10 < j <= i) for i, _, _ in plain] or [0])
    hits = [sum(e == 0 for _, _, e in plain), sum(e == 1 for _, _, e in plain), quoted, len({t for _, t, _ in plain})]
    return [*map(math.log1p, hits), min(dense, 20) / 5, math.sqrt(min(1, len(plain) / len(words))) if words else 0.0]


def test_toxicity_equals_a_plain_version(spark):
    """The whole query: terms from plain counts, features word by word, and scores
    of coefficients at which the plain loss has no slope."""
    rng = random.Random(11)
    calm, bad = [f"{a}{b}" for a in ("calm", "tree", "river", "stone") for b in ("", "s", "ly", "ing")], ["idiot", "idiots", "stupid", "scumbag", "loser"]
    rows, labels = [], []
    for k in range(400):
        toxic = rng.random() < 0.3
        words = [rng.choice(calm) for _ in range(rng.randint(3, 30))]
        for _ in range(rng.randint(1, 4) if toxic else 0):
            w = rng.choice(bad)
            words.insert(rng.randrange(len(words) + 1), w if rng.random() < 0.7 else w[:2] + w[3:])
        if not toxic and rng.random() < 0.2:
            words += ['"idiot"'] if rng.random() < 0.5 else ["she", "said", "stupid"]
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    rows += [(900, None), (901, ""), (902, "12 !!")]
    folder = run_folder(spark, "toxicity")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    taught = [(t, y) for (k, t), (_, y) in zip(rows, labels, strict=False) if zlib.crc32(str(k).encode()) % 5]
    bag = lambda t: [(w, i) for i, w in enumerate(re.findall(r"[^\W\d_]+", t.lower()))]
    forms = lambda w: {w, *(f"{w[:n]}*" for n in (4, 5) if len(w) > n)}
    n1, n0 = sum(y for _, y in taught), sum(1 - y for _, y in taught)
    texts1, around, texts0 = Counter(), {}, Counter()
    for t, y in taught:
        words = [w for w, _ in bag(t)]
        for x in set().union(*map(forms, words)):
            (texts1 if y else texts0)[x] += 1
        if y:
            for i, w in enumerate(words):
                for x in forms(w):
                    around.setdefault(x, set()).add((words[i - 1] if i else "", words[i + 1] if i + 1 < len(words) else ""))
    weights = {}
    for x, k1 in texts1.items():
        k1, k0 = min(k1, len(around[x])), texts0[x]
        odds = math.log((k1 + 0.5) / (n1 + 1)) - math.log((k0 + 0.5) / (n0 + 1))
        if k1 > 1 and odds - 1.8 * math.sqrt(1 / (k1 + 0.5) + 1 / (k0 + 0.5)) > 1:
            weights[x] = min(5.0, odds)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.learn(docs, toxicity.learnable(spark.read.parquet(f"{folder}/labels.parquet")))
    assert model.lexicon.weights.keys() == weights.keys() and len(weights) >= 6
    assert all(abs(model.lexicon.weights[x] - w) < 1e-9 for x, w in weights.items())
    x = np.array([[*plain_features(t, weights), 1.0] for t, _ in taught])
    y = np.array([y for _, y in taught], float)
    slope = x.T @ ((1 / (1 + np.exp(-x @ model.beta)) - y) / len(y)) + np.array([0.0002] * 6 + [1e-6]) * model.beta
    assert np.abs(slope).max() < 1e-6
    for r in op10_toxicity(spark, folder).collect():
        z = float(np.dot([*plain_features(dict(rows)[r.doc_id], weights), 1.0], model.beta))
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-9 and r.predicted == (r.score >= 0.5)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
