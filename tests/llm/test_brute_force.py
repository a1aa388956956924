"""Operators that SQL cannot express, against brute force, round trips and held-out accuracy."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from pulseforge.llm import decontaminate, exact_dedup, graph, language_id, mixing, pii, quality, simhash, substring_dedup, warc


def texts(sf, spark):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]


def removed(docs, width=100):
    seen, out = set(), {}
    for d, text in sorted(docs):
        data = text.encode()
        gone = bytearray(len(data))
        for i in range(len(data) - width + 1):
            w = data[i : i + width]
            if w in seen:
                gone[i : i + width] = b"\1" * width
            seen.add(w)
        runs = sum(1 for k in range(len(gone)) if gone[k] and (not k or not gone[k - 1]))
        out[d] = (len(data), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(data, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("group_bytes,hot", [(1 << 24, 4096), (40_000, 2)])
def test_substrings(spark, sf, group_bytes, hot):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.dedup_substrings(df, group_bytes=group_bytes, hot=hot).collect()}
    assert got == removed(texts(sf, spark))


def test_substrings_that_repeat_in_many_ways(spark):
    rng = random.Random(3)
    base = "".join(rng.choice("abc \0") for _ in range(900))
    docs = [(i, base[rng.randrange(300) :][: rng.randrange(80, 700)] + rng.choice(["", "Q"]) + "ab" * rng.randrange(120)) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for group_bytes, hot in ((1 << 20, 4096), (3000, 3)):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.dedup_substrings(df, group_bytes=group_bytes, hot=hot).collect()}
        assert got == removed(docs)


def test_substrings_of_rows_that_share_an_id(spark):
    rng = random.Random(4)
    base = "".join(rng.choice("abcd ") for _ in range(600))
    rows = [(rng.choice([None, 1, 2, 2, 3]), base[rng.randrange(300) :][: rng.randrange(50, 300)] + rng.choice(["", "Q"]) * 3) for _ in range(40)]
    rows += rows[:5]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    order = {(r.doc_id, r.text): (r.doc_id is not None, r.doc_id or 0, r.t) for r in df.select("doc_id", "text", F.xxhash64("text").alias("t")).collect()}
    want = removed([(order[k], k[1]) for k in order])
    got = substring_dedup.dedup_substrings(df, group_bytes=900, hot=3).collect()
    assert sorted((repr(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted((repr(d), *want[order[d, t]]) for d, t in rows)


def test_substring_hashes_are_confirmed_by_bytes(spark, monkeypatch):
    """With a hash that says everything is equal, nothing but equal bytes may be folded."""
    rng = random.Random(5)
    docs = [(i, 0, "".join(rng.choice("ab") for _ in range(140)).encode()) for i in range(30)] + [(99, 0, b"a" * 400)]
    monkeypatch.setattr(substring_dedup, "_mixed", lambda h: np.zeros_like(h))
    keys = np.unique(np.concatenate([r["key"] for r, _, _ in substring_dedup.runs_of(docs)]))
    docs_t = pa.table({k: [d[i] for d in docs] for i, k in enumerate(("doc", "t", "text"))})
    replies = pa.table({"a": [keys.tobytes()], "b": [np.zeros(len(keys), np.uint8).tobytes()]})
    out = substring_dedup.send_runs(1)((pa.scalar(0),), docs_t, replies).to_pylist()
    cuts = np.concatenate([np.frombuffer(r["a"], substring_dedup.CUTS) for r in out if r["kind"] == 3] or [np.zeros(0, substring_dedup.CUTS)])
    assert set(cuts["doc"].tolist()) <= {99}


def test_substring_messages_grow_with_the_text():
    for size in (10**8, 10**9, 10**10, 10**11):
        assert (size / substring_dedup.group_size(size)) ** 2 <= size / 16000
    assert substring_dedup.group_size(10**15) == substring_dedup.MOST_GROUP_BYTES


def slow_fingerprint(text):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def components(fps, radius=2):
    ids, parent = list(fps), {i: i for i in fps}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {i: top(i) for i in ids}


def test_simhash(spark, sf):
    docs = texts(sf, spark)
    fps = {d: slow_fingerprint(t) for d, t in docs}
    got = {r.doc_id: r for r in simhash.simhash_digest(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert {d: f"{f:016x}" for d, f in fps.items()} == {d: r.fingerprint for d, r in got.items()}
    assert components(fps) == {d: r.component_id for d, r in got.items()}


def test_bk_trees_in_shares_lose_no_link(spark):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(4)]
    fps = {i: rng.choice(centres) ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for i in range(300)}
    distinct = sorted(set(fps.values()))
    df = spark.createDataFrame([(simhash._signed(f),) for f in distinct], "fp long")
    for most in (8, 2048):
        links = simhash.near_links(df, tree_nodes=most).collect()
        assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 2 for r in links)
        label = {f: i for i, f in enumerate(distinct)}
        want = components({i: f for f, i in label.items()})
        edges = spark.createDataFrame([(label[r.a & (1 << 64) - 1], label[r.b & (1 << 64) - 1]) for r in links], "a long, b long")
        got = {r.node: r.label for r in graph.connected_components(edges).collect()}
        assert all(got.get(i, i) == c for i, c in want.items())


def test_components_of_a_long_chain(spark):
    n = 200
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.label for r in graph.connected_components(edges).collect()}
    assert {got[i] for i in range(n)} == {0} and got[1001] == 1000


def test_splitting_tree_sums(spark):
    quotas = spark.createDataFrame([("a", 1000), ("b", 37), (None, 5), ("z", 0)], "source string, quota long")
    rows = mixing.splitting_tree(quotas, 8).collect()
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r.quota)
    assert {k: sum(v) for k, v in by.items()} == {"a": 1000, "b": 37, None: 5, "z": 0}
    sizes = [sum(r.quota for r in rows if r.shard == s) for s in range(8)]
    assert max(sizes) - min(sizes) <= 3 and min(min(v) for v in by.values()) >= 0


def test_mix_is_near_its_targets_and_repeats(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    plan = mixing.plan_mix(d, 4).collect()
    taken, target = {}, {}
    for r in plan:
        taken[r.source] = taken.get(r.source, 0) + sum(x.words for x in r.draws)
        target[r.source] = r.target
        assert sum(x.words for x in r.draws) <= 3 * r.size
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    assert {(r.doc_id, str(r.draws)) for r in plan} == {(r.doc_id, str(r.draws)) for r in mixing.plan_mix(d.repartition(7), 4).collect()}
    per = {}
    for r in plan:
        for x in r.draws:
            per[x.shard] = per.get(x.shard, 0) + 1
    assert max(per.values()) - min(per.values()) <= 2
    path = mixing.write_mix(d, shards=4)
    assert spark.read.parquet(path).count() == sum(len(r.draws) for r in plan)


def test_language_on_held_out_documents(spark, sf):
    d = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet")
    got = language_id.language_digest(d).join(d.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null").collect()
    assert len(got) > 100 and np.mean([r.lang == r.lang_pred for r in got]) >= 0.98


def test_folded_kernel_is_the_two_step_product():
    texts = ["the house of the rising sun", "la maison de la reine", "das haus der lichter", "and then the night", "et puis la nuit", "und dann die nacht"] * 4
    langs = ["en", "fr", "de", "en", "fr", "de"] * 4
    x = np.array([language_id.presence(t) for t in texts])
    m = language_id.fit(np.packbits(x, axis=1), langs, np.arange(len(texts)) < 6)
    names, scores = m.score(["the light of the house", "die lichter der nacht", None, "12 3"])
    assert names == ["en", "de", "und", "und"] and all(0 <= s <= 1 for s in scores)
    grams = lambda t: set(np.flatnonzero(language_id.presence(t)))
    a, b = grams(texts[0]), grams(texts[3])
    k = len(a & b) / np.sqrt(len(a) * len(b))
    xa, xb = (language_id.presence(t).astype(float) for t in (texts[0], texts[3]))
    assert xa @ xb / np.sqrt(xa.sum() * xb.sum()) == pytest.approx(k)


def test_quality_finds_the_toxic_and_keeps_the_clean(spark, sf):
    big = sf.replace("0.001", "0.1")
    d, lab = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    d = d.join(lab.select("doc_id"), "doc_id", "left_semi")
    got = quality.classify(d, lab.filter("doc_id % 4 <> 0")).join(lab, "doc_id").filter("doc_id % 4 = 0").collect()
    toxic = [r for r in got if r.toxic]
    clean = [r for r in got if r.quality and not r.toxic]
    assert np.mean([not r.keep for r in toxic]) >= 0.8 and np.mean([r.keep for r in clean]) >= 0.97


def test_site_posteriors(spark):
    rng = random.Random(2)
    rows = [(i, f"h{i % 5}", f"h{i % 5}/{i % 2}", rng.random() * 0.5 + 0.1 * (i % 5), rng.random()) for i in range(400)] + [(999, "rare", "rare/0", 0.01, 0.99)]
    df = spark.createDataFrame(rows, "doc_id long, host string, path string, p_quality double, p_toxic double")
    got = {r.path: r for r in quality.site_posteriors(df).collect()}
    mean = np.mean([r[3] for r in rows])
    for r in got.values():
        raw = np.mean([x[3] for x in rows if x[1] == r.host])
        assert min(raw, mean) - 1e-9 <= r.host_quality <= max(raw, mean) + 1e-9
    rare = got["rare/0"]
    assert abs(rare.path_quality - mean) < abs(0.01 - mean)
    hosts = {h: [x[3] for x in rows if x[1] == h] for h in {x[1] for x in rows}}
    n = len(rows)
    spread = sum(len(v) * (np.mean(v) - mean) ** 2 for v in hosts.values())
    between = (spread - len(hosts) * mean * (1 - mean)) / n
    k = min(max(mean * (1 - mean) / between - 1, 1), 1e6) if between > 0 else 1e6
    assert rare.host_quality == pytest.approx((k * mean + 0.01) / (k + 1))


def slow_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_lcs():
    rng = random.Random(4)
    for _ in range(50):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(30))] for _ in range(2))
        assert decontaminate.lcs(a, b) == slow_lcs(a, b)


def test_word_ids_do_not_depend_on_neighbours():
    words = ["alpha", "Beta,", "gamma.", "x" * 70000, "é", "alpha"]
    alone = [int(decontaminate.word_ids([w])[0][0]) for w in words]
    together = decontaminate.word_ids([" ".join(words), None, "", "beta"])
    assert together[0].tolist() == alone and len(together[1]) == len(together[2]) == 0 and int(together[3][0]) == alone[1]


def test_contamination_and_paraphrases(spark, sf):
    big = sf.replace("0.001", "0.01")
    d, b = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/benchmark.parquet")
    docs, items = [(r.doc_id, r.text or "") for r in d.collect()], [(r.item_id, r.text) for r in b.collect()]
    rng = random.Random(6)
    planted = {}
    for n, (i, t) in enumerate(items[:20]):
        words = t.split()
        for _ in range(len(words) // 8):
            words[rng.randrange(len(words))] = f"new{rng.randrange(99)}"
        host = docs[n * 7][1].split()[:150]
        planted[10_000 + n] = (i, " ".join(host[:60] + words + host[60:]))
    d = d.select("doc_id", "text").union(spark.createDataFrame([(k, t) for k, (_, t) in planted.items()], "doc_id long, text string"))
    got = {r.doc_id: set(r.item_ids) for r in decontaminate.decontamination_report(d, b).collect()}
    truth = {k: {i for i, t in items if t in text} for k, text in docs}
    assert all(truth[k] <= got[k] for k in truth)
    assert sum(bool(got[k]) and not truth[k] for k in truth) <= 5
    assert np.mean([i in got[k] for k, (i, _) in planted.items()]) >= 0.9
    blocks = decontaminate.find_items(d, b, item_block=70).collect()
    assert {r.doc_id: {x.item_id for x in r["items"]} for r in blocks} == got


def test_pii_spans(spark):
    text = "é mail a.b@c.org_x@y.co.uk or call +1 (626) 555-4533; card 4111 1111 1111 1111, 4111111111111112; ip 10.0.0.256 10.00.0.255.7 IBAN DE89370400440532013000, XDE89370400440532013000 ssn 123-45-6789 and 123-45-6780."
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = [(x["kind"], x["m"]) for x in pii.find_pii(df).first().found]
    assert found == [("email", "a.b@c.org"), ("email", "_x@y.co.uk"), ("ip", "10.00.0.255"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (626) 555-4533"), ("iban", "DE89370400440532013000"), ("ssn", "123-45-6789"), ("ssn", "123-45-6780")]
    assert all(text[x["s"] : x["e"]] == x["m"] for x in pii.find_pii(df).first().found)
    assert pii.mask_pii(df).first().text.startswith("é mail <email><email> or call <phone>; card <card>, 4111111111111112; ip 10.0.0.256 <ip>.7 IBAN <iban>,")
    far = spark.createDataFrame([(1, "number 123-45-6789 alone")], "doc_id long, text string")
    assert pii.find_pii(far).first().found == []


def test_pii_context_on_either_side_and_grouped_ibans(spark):
    hexes = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"
    texts = ["123-45-6789 is my ssn", "pay to DE89 3704 0044 0532 0130 00 now", "DE89 3704 0044 0532 0130 01", f'token = "{hexes}"', f"commit {hexes}", f"{hexes} is the api key", f"token x{hexes}", "no 10.0.0.1 here", "the host 10.0.0.1"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(x["kind"], x["m"], round(x["score"], 2)) for x in r.found] for r in pii.find_pii(df).collect()}
    assert got[0] == [("ssn", "123-45-6789", 0.5)]
    assert got[1] == [("iban", "DE89 3704 0044 0532 0130 00", 0.9)] and got[2] == []
    assert got[3] == got[5] == [("secret", hexes, 0.6)] and got[4] == got[6] == []
    assert got[7] == [("ip", "10.0.0.1", 0.5)] and got[8] == [("ip", "10.0.0.1", 0.8)]


def test_pii_on_long_runs(spark):
    df = spark.createDataFrame([(1, "7" * 60000), (2, "a." * 40000 + "@"), (3, "+1" + " " * 50000 + "2"), (4, "1." * 30000)], "doc_id long, text string")
    assert all(r.n_email == 0 and r.n_card == 0 for r in pii.pii_digest(df).collect())


def test_warc_random_access(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    index = warc.write_archives(pages)
    of = {r.page_id: r.html or "" for r in pages.collect()}
    for r in index.limit(40).collect():
        head, block = warc.read_record(r.bundle, r.frame, r.record_offset)
        page = int(r.record_id.split(":")[2])
        assert head["WARC-Record-ID"] == f"<{r.record_id}>"
        if head["WARC-Type"] == "response":
            assert block.split(b"\r\n\r\n", 1)[1] == of[page].encode()
        with open(r.bundle.removeprefix("file://"), "rb") as f:
            f.seek(r.frame_offset)
            assert f.read(4) == b"\x28\xb5\x2f\xfd"


def test_warc_is_read_back_by_many_tasks(spark, sf):
    index = warc.write_archives(spark.read.parquet(f"{sf}/pages.parquet").repartition(2), frame_bytes=4096)
    assert index.select("bundle").distinct().count() <= 2
    dealt = warc.stretches(index, 2)
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) <= 2 * min(sizes) + 1
    back = warc.read_archives(index, 2)
    assert back.rdd.getNumPartitions() == len(sizes) and back.count() == index.count()


def test_warc_identifiers_differ(spark):
    big = "<p>" + "x" * 200
    rows = [(None, "a", big), (None, "b", "y" * 150), (1, "c", big), (1, "c", big), (1, "d", "z"), (2, "e", big), (2, "e", big + "!"), (None, "f", "y" * 150)]
    index = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"))
    found = {r.record_id: warc.read_record(r.bundle, r.frame, r.record_offset) for r in index.collect()}
    assert len(found) == len(rows)
    revisits = [h for h, _ in found.values() if h["WARC-Type"] == "revisit"]
    for head in revisits:
        first = found[head["WARC-Refers-To"].strip("<>")][0]
        assert first["WARC-Type"] == "response" and first["WARC-Payload-Digest"] == head["WARC-Payload-Digest"]
    assert len(revisits) == 2


def test_pipeline_is_its_stages_and_their_decisions_hold(spark, sf):
    out = corpus_pipeline.run(spark, sf).select("doc_id").distinct().count()
    d = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = [d.count()]
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, d, sf)
        d = corpus_pipeline.durable(kept, "test_stage")
        sizes.append(d.select("doc_id").distinct().count())
        if name == "exact dedup":
            assert d.select(F.lower("text")).distinct().count() == d.count()
        if name == "benchmark decontamination":
            items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert not any(i in r.text for r in d.collect() for i in items)
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] == out and sizes[1] > 0.95 * sizes[0]
