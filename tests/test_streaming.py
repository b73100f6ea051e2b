"""The reducers under Structured Streaming: same result as the batch job."""

import uuid

from insight.operators.events import event_reduce, split_views
from insight.plans.views import ev
from insight.session import checkpoint_root
from insight.sources.sinks import write_json
from insight.streaming.events import read_counts, read_event_stream, read_lookup, start_event_counter, start_lookup, start_reduction


def test_stream_matches_batch(spark, sf_dir):
    root = f"{checkpoint_root(spark)}/test-stream-{uuid.uuid4().hex}"
    raw = ev(spark, sf_dir)
    write_json(raw.repartition(4), f"{root}/in", gzip=True)
    stream = read_event_stream(spark, f"{root}/in", raw.schema, max_files_per_trigger=2)
    q = start_reduction(stream, f"{root}/out", f"{root}/ckpt")
    q.awaitTermination(300)
    got = spark.read.parquet(f"{root}/out/views").drop("batch")
    want = split_views(event_reduce(raw))
    assert got.count() == want.count()
    assert sorted(r[0] for r in got.select("event_id").collect()) == \
        sorted(r[0] for r in want.select("event_id").collect())
    # a restarted query finds nothing new and rewrites nothing
    q2 = start_reduction(read_event_stream(spark, f"{root}/in", raw.schema), f"{root}/out", f"{root}/ckpt")
    q2.awaitTermination(300)
    assert spark.read.parquet(f"{root}/out/views").count() == want.count()


def test_stream_counter(spark, sf_dir):
    root = f"{checkpoint_root(spark)}/test-counter-{uuid.uuid4().hex}"
    raw = ev(spark, sf_dir)
    write_json(raw.repartition(3), f"{root}/in")
    q = start_event_counter(read_event_stream(spark, f"{root}/in", raw.schema, max_files_per_trigger=1),
                            f"{root}/ckpt", f"{root}/counts")
    q.awaitTermination(300)
    got = {r["event_name"]: r["n_events"] for r in read_counts(spark, f"{root}/counts").collect()}
    assert sum(got.values()) == raw.count()


def test_replayed_and_reordered_batches_end_in_the_batch_lookup(spark):
    root = f"{checkpoint_root(spark)}/test-lookup-{uuid.uuid4().hex}"
    schema = "at long, id long, k string, v string"
    batches = [[(9, 1, "a", "newest"), (2, 2, "b", None), (5, 3, None, "n")], [(1, 4, "a", "late"), (7, 5, "b", "x")],
               [(9, 1, "a", "newest"), (2, 2, "b", None)], [(8, 6, "b", None), (3, 7, "c", "c"), (9, 0, "a", "tie before")]]

    def run():
        stream = read_event_stream(spark, f"{root}/in", spark.createDataFrame([], schema).schema, fmt="parquet")
        start_lookup(stream, "k", ["v"], ["at", "id"], f"{root}/ckpt", f"{root}/out").awaitTermination(300)
        return {r.k: (r.v, r.first_seen["at"]) for r in read_lookup(spark, f"{root}/out", "k").collect()}

    for b in batches:  # the query is started again for each: its state comes from the checkpoint
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
        got = run()
    assert got == {"a": ("newest", 1), "b": (None, 2), None: ("n", 5), "c": ("c", 3)}
    assert run() == got
