"""The two learned operators' whole queries against plain Python over the same table."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseforge.llm import language_id, quality


def logit(p):
    p = min(max(p, 1e-9), 1 - 1e-9)
    return math.log(p / (1 - p))


def strength(groups, prior, trait):
    n = sum(len(v) for v in groups.values())
    spread = sum(len(v) * (np.mean([p[trait] for p in v]) - prior[g][trait]) ** 2 for g, v in groups.items())
    noise = sum(prior[g][trait] * (1 - prior[g][trait]) for g in groups)
    base = sum(len(v) * prior[g][trait] * (1 - prior[g][trait]) for g, v in groups.items()) / n
    between = (spread - noise) / n
    return min(max(base / between - 1, 1.0), quality.MOST_SHRINK) if between > 0 else quality.MOST_SHRINK


def test_quality_is_that_of_plain_python(spark, sf):
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    d = d.union(d.limit(1).withColumn("source", F.lit("alone")))
    rows = d.select("doc_id", "text", "source", "lang").collect()
    models = quality.learn(d, labels)
    p = [[m.probability(*f) for m in models] for f in quality.features([r.text for r in rows])]
    hosts, paths, path_of = defaultdict(list), defaultdict(list), {}
    for r, x in zip(rows, p, strict=True):
        path = "/".join(v for v in (r.source, r.lang) if v is not None)
        hosts[r.source].append(x)
        paths[r.source, path].append(x)
        path_of[r.source, path] = r.source
    want = []
    for t in range(2):
        mean = {h: {t: np.mean([x[t] for x in p])} for h in hosts}
        kh = strength(hosts, mean, t)
        shrunk = {h: {t: (kh * mean[h][t] + sum(x[t] for x in v)) / (kh + len(v))} for h, v in hosts.items()}
        kp = strength(paths, {g: shrunk[path_of[g]] for g in paths}, t)
        post = []
        for r, x in zip(rows, p, strict=True):
            host, m = hosts[r.source], mean[r.source][t]
            path = paths[r.source, "/".join(v for v in (r.source, r.lang) if v is not None)]
            h = (kh * m + sum(y[t] for y in host) - x[t]) / (kh + len(host) - 1)
            q = (kp * h + sum(y[t] for y in path) - x[t]) / (kp + len(path) - 1)
            post.append(1 / (1 + math.exp(-(logit(x[t]) + quality.SITE_WEIGHT * (logit(q) - logit(m))))))
        want.append(post)
    got = quality.classify(d, labels).select("doc_id", "host", "post_quality", "post_toxic", "keep").collect()
    key = lambda x: (x[0], repr(x[1]), round(x[2], 6))
    a = sorted(((r.doc_id, r.host, r.post_quality, r.post_toxic, r["keep"]) for r in got), key=key)
    b = sorted(((r.doc_id, r.source, x, y, x >= 0.5 and y < 0.5) for r, x, y in zip(rows, *want, strict=True)), key=key)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x[:2] == y[:2] and x[2:4] == pytest.approx(y[2:4], abs=1e-6) and x[4] == y[4]


def test_a_document_alone_on_its_path_says_nothing_more_of_itself(spark):
    rows = [(i, "h", "h/a", 0.9, 0.1) for i in range(50)] + [(99, "h", "h/b", 0.2, 0.1)]
    df = spark.createDataFrame(rows, "doc_id long, host string, path string, p_quality double, p_toxic double")
    site = {r.path: r for r in quality.site_posteriors(df).collect()}["h/b"]
    assert (site.n, site.s_quality) == (1, pytest.approx(0.2))
    assert site.host_s_quality - 0.2 == pytest.approx(45.0)


def test_labels_and_texts_of_a_repeated_id(spark):
    docs = [(i, f"good words here number {i} " * 5 if i % 2 else f"bad junk {i} $$$ " * 5) for i in range(40)]
    again = docs + [(i, t + "and another text") for i, t in docs[:10]]
    labels = [(i, i % 2, 1 - i % 2) for i in range(40)] + [(3, 0, 0), (4, None, 1)]
    lab = spark.createDataFrame(labels, "doc_id long, quality long, toxic long")
    learned = [quality.learn(spark.createDataFrame(x, "doc_id long, text string").repartition(n), lab.repartition(n)) for x, n in ((again, 2), (again[::-1], 7))]
    for a, b in zip(*learned, strict=True):
        assert np.array_equal(a.chosen, b.chosen) and np.allclose(a.words, b.words) and a.bias == pytest.approx(b.bias)


def test_language_is_that_of_plain_kernels(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    rows = d.withColumn("out", language_id.held_out()).withColumn("h", F.xxhash64(F.lit("learn"), "doc_id", "text")).collect()
    grams = {r.text: frozenset(np.flatnonzero(language_id.presence(r.text)).tolist()) for r in rows if r.text is not None}
    kernel = lambda x, y: len(grams[x] & grams[y]) / math.sqrt(len(grams[x]) * len(grams[y]))
    langs = sorted({r.lang for r in rows if r.lang is not None and not r.out and r.text is not None})
    ranked = {n: sorted({(r.h, r.text) for r in rows if r.lang == n and not r.out and r.text is not None})[: language_id.LEARN_PER_LANG] for n in langs}
    learned = sorted((k, n, h, t) for n, v in ranked.items() for k, (h, t) in enumerate(v))
    marks = [t for k, _, _, t in learned if k < language_id.LANDMARKS_PER_LANG]
    values, vectors = np.linalg.eigh(np.array([[kernel(a, b) for b in marks] for a in marks]))
    root = vectors / np.sqrt(np.maximum(values, 1e-6))
    z = np.array([[kernel(t, m) for m in marks] for *_, t in learned]) @ root
    y = np.array([[float(n == lang) for n in langs] for _, lang, _, _ in learned])
    w = np.linalg.solve(z.T @ z + language_id.RIDGE * np.eye(len(marks)), z.T @ y)
    got = {r.doc_id: r for r in language_id.language_digest(d).collect()}
    assert len(got) == len(rows)
    for r in rows:
        if not language_id.has_letter(r.text):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        scores = np.array([kernel(r.text, m) for m in marks]) @ root @ w
        best = int(scores.argmax())
        assert got[r.doc_id].held_out == r.out
        assert got[r.doc_id].lang_pred == langs[best] or scores[best] - sorted(scores)[-2] < 1e-2
        assert got[r.doc_id].score == pytest.approx(float(np.clip(scores[best], 0, 1)), abs=2e-2)


def test_many_languages_share_the_sample(spark):
    rows = [(i, f"l{i % 30}", f"text of {i} " * 4) for i in range(900)]
    d = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    before = language_id.MAX_LEARN, language_id.MAX_LANDMARKS
    language_id.MAX_LEARN, language_id.MAX_LANDMARKS = 90, 20
    try:
        assert len(language_id.learn(d).langs) == 30
    finally:
        language_id.MAX_LEARN, language_id.MAX_LANDMARKS = before
