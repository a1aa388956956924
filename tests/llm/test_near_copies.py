"""The near-copy stage against brute force over five-word shingles."""

import random

from pulseforge.llm import simhash


def sets(text):
    words = text.lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, 1))}


def test_near_copies_are_those_of_brute_force(spark):
    rng = random.Random(13)
    bases = [[f"w{rng.randrange(4000)}" for _ in range(rng.randrange(30, 400))] for _ in range(12)]
    docs = []
    for i in range(240):
        words = list(rng.choice(bases))
        for _ in range(rng.randrange(1 + len(words) // 40)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(999)}"
        docs.append((i, " ".join(words)))
    grams, parent = [sets(t) for _, t in docs], list(range(len(docs)))

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(docs)):
        for j in range(i):
            both = len(grams[i] & grams[j])
            if both >= 0.8 * (len(grams[i]) + len(grams[j]) - both):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    kept = {r.doc_id for r in simhash.keep_one_of_each(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert kept == {k for k, p in enumerate(parent) if k == p} and len(kept) < len(docs)


def jaccard(a, b):
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def test_texts_with_a_repeated_tail_are_near(spark):
    rng = random.Random(4)
    rows = []
    for k in range(3):
        words = [f"w{rng.randrange(9000)}" for _ in range(300)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words + ["junk"] * 400))]
        assert jaccard(sets(rows[-1][1]), sets(rows[-2][1])) > 0.98
    kept = {r.doc_id for r in simhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {0, 2, 4}


def test_few_pairs_of_small_sets_lie_beyond_the_cut():
    """Sets of 4 to 40 shingles at the least similarity: their fingerprints' distances, as the docstring says."""
    rng, found = random.Random(8), []
    for _ in range(4000):
        n = rng.randrange(5, 41)
        words = [f"v{rng.randrange(10**6)}" for _ in range(n + 4)]
        a = [" ".join(words[i : i + 5]) for i in range(n)]
        b = a[: -max(n // 5, 1)] if rng.random() < 0.5 else a[n // 10 :] + [f"x{k}" for k in range(n // 10)]
        assert jaccard(set(a), set(b)) >= 0.8 - 1e-9
        of = lambda s: simhash.majority(simhash.np.array([simhash.xxhash.xxh64_intdigest(x.encode(), 42) for x in s], dtype="<u8"))
        found.append((of(a) ^ of(b)).bit_count())
    assert max(found) <= simhash.WIDE_RADIUS - 2 and 5 < sum(found) / len(found) < 13


def test_small_texts_by_brute_force(spark):
    rng = random.Random(21)
    rows = []
    for k in range(60):
        words = [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(9, 30))]
        rows += [(10 * k, " ".join(words)), (10 * k + 1, " ".join(words[:-1])), (10 * k + 2, " ".join([*words, *words])), (10 * k + 3, " ".join(words[3:]))]
    grams = [sets(t) for _, t in rows]
    top = list(range(len(rows)))
    for _ in range(4):
        for i in range(len(rows)):
            for j in range(i - i % 4, i):
                if jaccard(grams[i], grams[j]) >= 0.8:
                    top[i] = top[j] = min(top[i], top[j])
    kept = {r.doc_id for r in simhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {rows[k][0] for k, t in enumerate(top) if t == k}
