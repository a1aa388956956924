"""The whole pipeline against a slow version of each stage in plain Python, on every document of the small table."""

import re

import corpus_pipeline
from pulseforge.llm import decontaminate, language_id, mixing


def five_grams(text):
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def holds(item, words):
    """Whether a stretch of about the item's length, anywhere, covers enough of the item in order."""
    n = len(item)
    if not n:
        return False
    tail = item[-decontaminate.ANSWER :]
    for s in range(-n, max(len(words), 1), max(n // 8, 1)):
        part = words[max(s - n // 2, 0) : s + n + n // 2]
        covered = decontaminate.lcs(item, part) / n
        if covered >= decontaminate.SURE_LCS or covered >= decontaminate.MIN_LCS and decontaminate.lcs(tail, part) >= decontaminate.MIN_ANSWER * len(tail):
            return True
    return False


def test_pipeline_is_that_of_plain_python(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in d.collect()}
    model = language_id.learn(d)
    ids = sorted(rows)
    names, scores = model.score([rows[i].text for i in ids])
    ids = [i for i, n, s in zip(ids, names, scores, strict=True) if n != "und" and s >= language_id.LEAST_SCORE]

    lower = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t)
    last = {lower(rows[i].text): i for i in ids}
    ids = sorted(last.values())

    grams, top = {i: five_grams(rows[i].text) for i in ids}, {i: i for i in ids}

    def least(i):
        while top[i] != i:
            i = top[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(grams[i] & grams[j])
            if both >= 0.8 * (len(grams[i]) + len(grams[j]) - both):
                a, b = sorted((least(i), least(j)))
                top[b] = a
    ids = [i for i in ids if top[i] == i]

    items = [x.tolist() for x in decontaminate.word_ids([r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])]
    words = dict(zip(ids, decontaminate.word_ids([rows[i].text for i in ids]), strict=True))
    ids = [i for i in ids if not any(len(set(item) & set(w)) >= 0.3 * len(item) and holds(item, w) for item in items for w in [words[i].tolist()])]

    out = corpus_pipeline.run(spark, sf).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", rows[i].text)) for i in ids}
    drawn = {}
    for r in out:
        drawn[r.doc_id] = drawn.get(r.doc_id, 0) + r.words
        assert r.text == rows[r.doc_id].text or r.text == " ".join(rows[r.doc_id].text.split()[: r.words])
        assert r.words == len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) and r.source == rows[r.doc_id].source
    assert set(drawn) <= set(ids)
    sources = sorted({rows[i].source for i in ids}, key=lambda s: (s is None, s))
    total = {s: sum(size[i] for i in ids if rows[i].source == s) for s in sources}
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(sources)}
    target, free, rest = {}, list(sources), sum(total.values())
    while over := [s for s in free if rest * weight[s] / sum(weight[x] for x in free) > 3 * total[s]]:
        for s in over:
            target[s] = 3 * total[s]
            free.remove(s)
        rest = sum(total.values()) - sum(target.values())
    target |= {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
    taken = {s: sum(n for i, n in drawn.items() if rows[i].source == s) for s in sources}
    assert all(abs(taken[s] - target[s]) <= 1 for s in sources)
    whole = [i for i in ids if size[i] and target[rows[i].source] >= total[rows[i].source] + 1]
    assert set(whole) <= set(drawn)
    assert all(drawn[i] <= 3 * size[i] for i in drawn)
