"""Benchmark items of any length, in tables of any size, and cut at either end."""

import random

import numpy as np

from pulseforge.llm import decontaminate


def found(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return {r.doc_id: {x.item_id for x in r["items"]} for r in decontaminate.find_items(d, b).collect()}


def prose(rng, n):
    return [f"w{int(rng.paretovariate(0.7)) % 5000}x" for _ in range(n)]


def test_verbatim_items_of_any_length(spark):
    rng = random.Random(8)
    docs, items = [(1000 + k, " ".join(prose(rng, 300))) for k in range(60)], []
    for k, n in enumerate([4, 6, 8, 10, 12, 20, 48, 49, 60, 120, 121, 150, 200, 500, 1000] * 2):
        item, host = prose(rng, n), prose(rng, rng.randrange(5, 200))
        at = rng.randrange(len(host))
        items.append((k, " ".join(item)))
        docs.append((k, " ".join(host[:at] + item + host[at:])))
    got = found(spark, docs, items)
    assert [k for k, _ in items if k not in got[k]] == []
    blocks = decontaminate.find_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), item_block=7)
    assert {r.doc_id: {x.item_id for x in r["items"]} for r in blocks.collect()} == got


def test_long_items_with_replaced_words(spark):
    rng = random.Random(9)
    docs, items = [(1000 + k, " ".join(prose(rng, 300))) for k in range(60)], []
    for k in range(20):
        item = prose(rng, 150 + 20 * k)
        items.append((k, " ".join(item)))
        docs.append((k, " ".join([*prose(rng, 70), *[w if rng.random() < 0.85 else f"new{rng.randrange(99)}" for w in item], *prose(rng, 40)])))
    got = found(spark, docs, items)
    assert [k for k, _ in items if k not in got[k]] == []


def test_tables_of_few_texts(spark):
    rng = random.Random(10)
    for n in (1, 3, 6, 10, 30):
        docs = [(k, " ".join(prose(rng, rng.randrange(15, 40)))) for k in range(n)]
        got = found(spark, docs, docs)
        assert [k for k in range(n) if k not in got[k]] == []


def test_directions_span_few_texts():
    rng = np.random.default_rng(1)
    for n in (1, 3, 10, 30):
        texts = np.zeros((n, 1 << decontaminate.BITS))
        for row in texts:
            row[rng.choice(len(row), 30, replace=False)] = rng.random(30)
        b = texts.T @ (texts @ rng.standard_normal((texts.shape[1], decontaminate.SKIP + decontaminate.RANK + decontaminate.EXTRA)))
        latent = texts @ decontaminate.directions(b)
        held = np.linalg.norm(latent, axis=1)
        assert (held > 1e-3 * held.max()).all()


def test_items_cut_at_either_end(spark):
    rng = random.Random(11)
    docs, items = [(1000 + k, " ".join(prose(rng, 300))) for k in range(60)], []
    for k in range(20):
        item = [f"i{k}w{rng.randrange(999)}" for _ in range(20 + 6 * k)]
        cut = len(item) - len(item) * 13 // 100 - 3
        items.append((k, " ".join(item)))
        docs.append((k, " ".join(prose(rng, 50) + item[:cut])))
        docs.append((100 + k, " ".join(item[-cut:] + prose(rng, 50))))
    got = found(spark, docs, items)
    assert [k for k, _ in items if k not in got[k] or k not in got[100 + k]] == []


def edited(rng, words, kind, share=0.12):
    out = []
    for w in words:
        hit = rng.random() < share
        if kind == "insertion" and hit:
            out.append(f"new{rng.randrange(999)}")
        if kind == "replacement" and hit:
            out.append(f"new{rng.randrange(999)}")
        elif not (kind == "deletion" and hit):
            out.append(w)
    return out


def test_recall_of_each_kind_of_edit(spark):
    rng = random.Random(14)
    vocabulary, weights = [f"w{k}x" for k in range(4000)], [1 / (k + 10) for k in range(4000)]
    text = lambda n: rng.choices(vocabulary, weights, k=n)
    docs, items = [(1000 + k, " ".join(text(300))) for k in range(60)], []
    kinds = ("insertion", "deletion", "replacement")
    for k in range(60):
        item = text(rng.randrange(15, 60))
        items.append((k, " ".join(item)))
        for n, kind in enumerate(kinds):
            docs.append((10_000 * (n + 1) + k, " ".join(text(70) + edited(rng, item, kind) + text(40))))
    got = found(spark, docs, items)
    for n, kind in enumerate(kinds):
        assert np.mean([k in got[10_000 * (n + 1) + k] for k, _ in items]) >= 0.9, kind
    assert sum(bool(got[1000 + k]) for k in range(60)) <= 1


def test_candidates_and_shares_against_plain_loops():
    """Windows by cosine from sums over their own terms, and covered shares from a table, for every document and item."""
    rng, nrng = random.Random(15), np.random.default_rng(2)
    vocabulary = [f"v{k}" for k in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, decontaminate.word_ids([text(rng.randrange(5, 90))])[0]) for k in range(12)]
    docs = [decontaminate.word_ids([text(rng.randrange(3, 120))])[0] for _ in range(20)]
    for k in range(8):
        item, cut = items[k][1], rng.randrange(20)
        docs[k] = np.concatenate([docs[k][:cut], np.delete(item, len(item) // 2), docs[k][cut:]])
    idf = nrng.random(1 << decontaminate.BITS).astype(np.float32) + 1
    basis = nrng.standard_normal((1 << decontaminate.BITS, decontaminate.RANK)).astype(np.float32)
    s = decontaminate.Searcher(items, idf, basis)
    small = [decontaminate.terms(x) for x in docs]
    got = s.candidates(small)

    def unit(words):
        v = (basis[words] * idf[words][:, None]).sum(axis=0)
        return v / max(np.linalg.norm(v), 1e-9)

    want = set()
    for k, (_, item) in enumerate(items):
        item = decontaminate.terms(item)
        for at in decontaminate.part_starts(len(item)):
            part = item[at : at + decontaminate.WINDOWS[-1][0]]
            w, step = min(decontaminate.WINDOWS, key=lambda x: abs(np.log(len(part)) - np.log(x[0])))
            for d, words in enumerate(small):
                last = max(-(-max(len(words) - w, 0) // step), 0)
                for i in range(last + 1):
                    window = words[i * step : i * step + w]
                    shared = sum(int(x) in set(item.tolist()) for x in words[i * step : i * step + w])
                    if unit(window) @ unit(part) >= decontaminate.MIN_COSINE and shared >= decontaminate.SHARED * min(len(part), w):
                        want.add((d, k))
    assert {(d, k) for d, k in want} <= set(got) | {(d, k) for d, k in s.run_starts(small)}
    assert len(want) >= 5
    for d, rows in enumerate(s.confirmed(docs)):
        for k, covered in rows:
            item, words = items[k][1].tolist(), docs[d].tolist()
            table = [[0] * (len(words) + 1) for _ in range(len(item) + 1)]
            for i, x in enumerate(item):
                for j, y in enumerate(words):
                    table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
            assert decontaminate.MIN_LCS <= covered <= table[-1][-1] / len(item)
            if d < 8 and k == d:
                assert covered == table[-1][-1] / len(item) or covered >= 0.9
    assert all(any(k == d for k, _ in s.confirmed(docs)[d]) for d in range(8))


def test_words_that_share_a_term_are_told_apart(spark):
    """Terms have few bits; a text of other words with the same terms is no copy of an item."""
    by_term = {}
    for k in range(200_000):
        by_term.setdefault(int(decontaminate.terms(decontaminate.word_ids([f"q{k}"])[0])[0]), []).append(f"q{k}")
        if k > 60_000 and sum(len(x) > 1 for x in by_term.values()) >= 40:
            break
    pairs = [x[:2] for x in by_term.values() if len(x) > 1][:40]
    items, docs = [(1, " ".join(a for a, _ in pairs))], [(1, " ".join(b for _, b in pairs)), (2, "so: " + " ".join(a for a, _ in pairs))]
    assert found(spark, docs, items) == {1: set(), 2: {1}}


def test_blocks_leave_one_searcher_in_a_stage(spark):
    rng = random.Random(16)
    docs = spark.createDataFrame([(k, " ".join(prose(rng, 60))) for k in range(20)], "doc_id long, text string")
    items = spark.createDataFrame([(k, " ".join(prose(rng, 20))) for k in range(40)], "item_id long, text string")
    plan = decontaminate.find_items(docs, items, item_block=10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 0


def test_words_longer_than_a_piece_count_whole():
    def by_definition(word):
        total, power = 0, 1
        for c in word.lower().encode():
            total, power = (total + (c + 1) * power) & M, power * decontaminate._BASE & M
        h = total * pow(decontaminate._BASE, 65535, 1 << 64) & M
        return (h ^ h >> 29) * 0xBF58476D1CE4E5B9 & M

    M = (1 << 64) - 1
    words = ["ab", "a" * 65534, "a" * 65535, "a" * 65536, "a" * 70000, "a" * 70000 + "b" * 500, "Z" * 200001, "end"]
    (found,) = decontaminate.word_ids([" ".join(words)])
    assert [int(x) for x in found] == [by_definition(w) for w in words]
    assert len(set(found.tolist())) == len(words)


def brute_force(texts, items):
    """(document number, item_id) of every item that some stretch of a document confirms, whatever stretch that is.

    The rule is the docstring's 4; a stretch is as long as the longest that the search looks at. Only what is lossless is skipped:
    stretches that hold less than MIN_LCS of an item's words in any order.
    """
    words = [t.lower().translate(str.maketrans({c: " " for c in ".,;:!?\"'()[]|"})).split() for t in texts]
    held = set()
    for item_id, text in items:
        a = text.lower().translate(str.maketrans({c: " " for c in ".,;:!?\"'()[]|"})).split()
        n = len(a)
        wide = 2 * n + 24
        for d, b in enumerate(words):
            near = np.concatenate([[0], np.cumsum(np.isin(b, a))]) if b else np.zeros(1)
            ends = np.minimum(np.arange(len(b)) + wide, len(b))
            for s in np.flatnonzero(near[ends] - near[np.arange(len(b))] >= decontaminate.MIN_LCS * n).tolist():
                some = b[s : s + wide]
                covered = decontaminate.lcs(a, some) / n
                tail = a[-decontaminate.ANSWER :]
                if covered >= decontaminate.SURE_LCS or covered >= decontaminate.MIN_LCS and decontaminate.lcs(tail, some) >= decontaminate.MIN_ANSWER * len(tail):
                    held.add((d, item_id))
                    break
    return held


def test_query_against_brute_force_over_the_tables(spark, sf):
    from pulseforge.llm.queries import QUERIES

    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if r.item_id is not None and r.text]
    want = {(docs[d][0], i) for d, i in brute_force([t for _, t in docs], items)}
    rows = QUERIES["op8_decontaminate"](spark, sf).collect()
    got = {(r.doc_id, i) for r in rows for i in r.item_ids}
    assert want and got <= want and len(got) >= 0.9 * len(want)
    assert all(r.contaminated == (r.n_items > 0) == (r.doc_id in {d for d, _ in got}) for r in rows) and len(rows) == len(docs)
