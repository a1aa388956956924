"""The digest index over several batches, other settings and repeated calls."""

import pytest

from pulseforge.llm import exact_dedup


def answers(index, rows, batch=None):
    df = index.spark.createDataFrame(rows, "doc_id long, text string")
    return {(r.doc_id, r.keep_id, r.kept) for r in index.deduplicate(df, batch).collect()}


def test_it_persists(spark):
    index = exact_dedup.DigestIndex(spark)
    assert answers(index, [(1, "A b"), (2, "a B"), (3, "c")]) == {(1, 2, False), (2, 2, True), (3, 3, True)}
    index.close()
    again = exact_dedup.DigestIndex(spark, index.path)
    assert answers(again, [(10, "C"), (11, "new")]) == {(10, 3, False), (11, 11, True)}
    assert again.rows().count() == 3


def test_reopened_under_other_settings(spark):
    index = exact_dedup.DigestIndex(spark, buckets=7)
    rows = [(i, f"text {i}") for i in range(500)]
    assert all(k for _, _, k in answers(index, rows))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for parts in ("2", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        again = exact_dedup.DigestIndex(spark, index.path)
        assert again.buckets == 7
        assert answers(again, [(1000 + i, t) for i, t in rows]) == {(1000 + i, i, False) for i, _ in rows}
    spark.conf.set("spark.sql.shuffle.partitions", before)
    with pytest.raises(ValueError):
        exact_dedup.DigestIndex(spark, index.path, buckets=8)


def test_a_batch_repeated_is_answered_alike(spark):
    index = exact_dedup.DigestIndex(spark)
    one, two = [(1, "a"), (2, "A"), (3, "b")], [(4, "b"), (5, "c")]
    first, second = answers(index, one, "one"), answers(index, two, "two")
    assert answers(index, one, "one") == first == {(1, 2, False), (2, 2, True), (3, 3, True)}
    assert answers(index, two, "two") == second == {(4, 3, False), (5, 5, True)}
    assert index.rows().count() == 3 and index.batches() == ["one", "two"]


def test_a_batch_cut_short_is_not_seen(spark):
    index = exact_dedup.DigestIndex(spark)
    store, index._store = index._store, lambda *a: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        answers(index, [(1, "a"), (2, "b")], "one")
    index._store = store
    assert index.rows().count() == 0
    assert answers(index, [(7, "a")], "other") == {(7, 7, True)}
    assert answers(index, [(1, "a"), (2, "b")], "one") == {(1, 7, False), (2, 2, True)}


def test_the_index_is_not_shuffled(spark):
    index = exact_dedup.DigestIndex(spark, buckets=3)
    answers(index, [(i, f"text {i}") for i in range(50)])
    groups = spark.createDataFrame([(b"x", 1, 1)], "digest binary, keep_id long, group_size long")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for parts in ("2", "20"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        df = index.answers(groups, "next")
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert "SortMergeJoin" in plan and plan.count("Exchange") == 1 and "Bucketed: true" in plan
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_no_index_row_is_sorted_or_shuffled(spark):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    for n in range(3):
        answers(index, [(1000 * n + i, f"text {i}") for i in range(50 * n, 50 * n + 80)], f"b{n}")
    groups = spark.createDataFrame([(bytes([k]), k, 1) for k in range(9)], "digest binary, keep_id long, group_size long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        with exact_dedup.sorted_buckets(spark):
            plan = index.answers(groups, "next")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("SortMergeJoin") == 3 and plan.count("Exchange") == 1 and plan.count("Sort [") == 1
    assert spark.conf.get("spark.sql.legacy.bucketedTableScan.outputOrdering") == "false"


def test_partitions_are_folded(spark):
    index, want = exact_dedup.DigestIndex(spark, buckets=3, most_parts=2), {}
    batches = [[(100 * n + i, f"t {(7 * n + i) % 40}") for i in range(15)] for n in range(7)]
    first = []
    for n, rows in enumerate(batches):
        got = answers(index, rows, f"b{n}")
        for i, t in rows:
            group = [j for j, u in rows if u == t]
            assert (i, want.get(t, max(group)), t not in want and i == max(group)) in got
        want |= {t: max(j for j, u in rows if u == t) for _, t in rows if t not in want}
        first.append(got)
        assert len(index.parts()) <= 2 and index.rows().count() == len(want)
    for n in (0, 3, 6):
        assert answers(index, batches[n], f"b{n}") == first[n] and index.rows().count() == len(want)
    again = exact_dedup.DigestIndex(spark, index.path)
    assert again.batches() == [f"b{n}" for n in range(7)] and again.rows().count() == len(want)
    assert answers(again, [(5000, "t 3"), (5001, "unseen")]) == {(5000, want["t 3"], False), (5001, 5001, True)}
