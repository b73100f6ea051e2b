"""Bucketed tables and the dictionary over several runs."""

import pytest
from pyspark.sql import functions as F

from insight import remove_scratch  # noqa: F401
from insight.operators.dictionary import KeptDictionary
from insight.operators.joins import join_sorted
from insight.session import scratch_path
from insight.sources.bucketed import BucketedTable


def test_layout_is_kept_and_checked(spark):
    path = scratch_path(spark, "t")
    one = BucketedTable(spark, path, "k string, v bigint", ["k"], 4)
    one.append(spark.range(50).selectExpr("cast(id AS string) AS k", "id AS v"))
    one.drop()  # as in a new session: the files are there, the catalogue knows nothing
    again = BucketedTable(spark, path, "k string, v bigint", ["k"])
    assert again.buckets == 4 and again.read().count() == 50
    with pytest.raises(ValueError):
        BucketedTable(spark, path, "k string, v bigint", ["k"], 7)
    with pytest.raises(ValueError):
        BucketedTable(spark, path, "k string", ["k"])


def test_compaction_and_other_bucket_counts(spark):
    path = scratch_path(spark, "t")
    t = BucketedTable(spark, path, "k string, v bigint", ["k"], 3)
    for i in range(3):
        t.append(spark.range(20).selectExpr("cast(id AS string) AS k", f"id + {i} AS v"))
    assert len(t.read().inputFiles()) > 3
    t.compact()
    assert len(t.read().inputFiles()) <= 3 and t.read().count() == 60
    t.compact(5)
    assert t.buckets == 5 and BucketedTable(spark, path, "k string, v bigint", ["k"]).generation == 2
    t.prune()
    t.drop()
    assert BucketedTable(spark, path, "k string, v bigint", ["k"], 5).read().count() == 60


def test_join_without_exchange(spark):
    tables = [BucketedTable(spark, scratch_path(spark, n), f"k bigint, {n} bigint", ["k"], 4) for n in "ab"]
    for t, n in zip(tables, "ab"):
        t.append(spark.range(100).selectExpr("id % 70 AS k", f"id AS {n}"))
    joined = join_sorted(*tables)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    assert joined.count() == 30 * 4 + 40
    with pytest.raises(ValueError):
        join_sorted(tables[0], BucketedTable(spark, scratch_path(spark, "c"), "k bigint, c bigint", ["k"], 5))


def test_scratch_tables_leave_the_catalogue(spark):
    t = BucketedTable(spark, scratch_path(spark, "t"), "k string", ["k"], 2)
    from insight import session
    names = [x.name for x in spark.catalog.listTables()]
    assert t.table in names
    kept, session.scratch_root = session.scratch_root, lambda s: f"{session.checkpoint_root(s)}/nothing"
    try:
        session.remove_scratch(spark)
    finally:
        session.scratch_root = kept
    assert t.table not in [x.name for x in spark.catalog.listTables()]


SCHEMA = "at long, v string"


def batches(spark):
    one = spark.createDataFrame([(3, "c"), (1, "b"), (2, None), (4, "b"), (9, "a")], SCHEMA)
    two = spark.createDataFrame([(10, "e"), (11, "a"), (12, None), (13, "d"), (13, "é"), (14, "e")], SCHEMA)
    return one, two


UNION = {"b": 1, None: 2, "c": 3, "a": 4, "e": 5, "d": 6, "é": 7}


def test_ids_of_two_batches_are_those_of_their_union(spark):
    path = scratch_path(spark, "d")
    one, two = batches(spark)
    kept = KeptDictionary(spark, path, buckets=3)
    assert {r.v: r.v_id for r in kept.encode(one, "v", ["at"]).collect()} == {k: UNION[k] for k in ("a", "b", "c", None)}
    kept.known.drop()
    kept = KeptDictionary(spark, path)  # a new run
    rows = kept.encode(two, "v", ["at"]).collect()
    assert {r.v: r.v_id for r in rows} == {k: UNION[k] for k in ("a", "e", "d", "é", None)} and len(rows) == 6
    for batch in (one, two, one.filter("false")):  # rerun, and an empty batch
        kept.encode(batch, "v", ["at"]).collect()
    assert {r.value: r.id for r in kept.table().collect()} == UNION


def test_a_job_that_died_before_its_append_is_finished(spark):
    path = scratch_path(spark, "d")
    one, two = batches(spark)
    kept = KeptDictionary(spark, path, buckets=3)
    kept.add(one, "v", ["at"])
    # the pending rows of the second batch were written, and one of them appended
    new = spark.createDataFrame([("e", 5), ("d", 6), ("é", 7)], "value string, id long")
    new.write.parquet(kept.pending)
    kept.known.append(new.filter("value = 'd'"))
    again = KeptDictionary(spark, path)
    assert {r.value: r.id for r in again.table().collect()} == UNION and again.table().count() == 7
    assert {r.value: r.id for r in again.add(two, "v", ["at"]).collect()} == {k: UNION[k] for k in ("a", "e", "d", "é", None)}


def test_a_hot_value_and_many_new_ones(spark):
    kept = KeptDictionary(spark, scratch_path(spark, "d"), "long", buckets=2)
    for i in range(2):
        batch = spark.range(i * 3000, (i + 1) * 3000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("v"))
        rows = kept.encode(batch, "v", ["id"])
        assert rows.count() == 3000
    ids = [r.id for r in kept.table().orderBy("id").collect()]
    assert ids == list(range(1, len(ids) + 1)) and len(ids) == 4001 - (7 % 3 != 0)
