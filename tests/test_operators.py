import random

import pytest
from pyspark.sql import functions as F

from tidemark import functions as fn
from tidemark.config import Config, seconds
from tidemark.operators import outcomes, scan, sequence, watermark, windows
from tidemark.sources import MessageSource, append_results, benchmark_results, benchmark_runs
from tidemark.streaming import committer_job, lifecycle


def fnv(text, mask):
    h = 2166136261
    for b in text.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h & mask


def test_fnv(spark):
    keys = ["", "a", "key-1", "é漢", "\0" * 1000, "x" * 300]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    for shards in (2, 16, 128):
        got = {r.key: r.shard for r in df.withColumn("shard", fn.shard_index("key", shards)).collect()}
        assert got == {k: fnv(k, shards - 1) for k in keys}
    for bad in (0, 1, 12):
        with pytest.raises(ValueError):
            fn.shard_index("key", bad)


def test_sizes():
    assert [fn.power_of_two(n) for n in (1, 2, 3, 17)] == [1, 2, 4, 32]
    assert fn.metrics_buffer(1, 1) == 20_000 and fn.metrics_buffer(5000, 64) == 100_000
    assert [fn.ingest_length(n) for n in (10, 250, 2000)] == [5000, 25_000, 100_000] and fn.idle_workers(250, 16) == 16


@pytest.mark.parametrize("size", [3, 1000])
def test_scan_is_the_same_for_any_block(spark, size):
    r = random.Random(size)
    data = [(r.choice("ab"), k, r.choice((None, r.randint(-9, 9)))) for k in r.sample(range(200), 60)]
    df = spark.createDataFrame(data, "g string, o long, v long")
    v = F.col("v")
    got = scan.prefix(df, ["g"], ["o"], scan.blocks("o", size), s=("sum", v), m=("max", v), n=("min", v), b=("sum_before", v), x=("max_before", v), p=("last_before", F.col("o")))
    for g in "ab":
        rows = sorted((o, x) for a, o, x in data if a == g)
        out = {r.o: r for r in got.where(F.col("g") == g).collect()}
        for k, (o, _) in enumerate(rows):
            upto, before = ([x for _, x in rows[: k + j] if x is not None] for j in (1, 0))
            w = out[o]
            assert (w.s, w.m, w.n, w.b, w.x, w.p) == (sum(upto), max(upto, default=None), min(upto, default=None), sum(before), max(before, default=None), rows[k - 1][0] if k else None)


@pytest.mark.parametrize("size", [3, 1000])
def test_queue_is_the_same_for_any_block(spark, size):
    r = random.Random(size)
    data = [(r.choice("ab"), k, r.randint(0, 90), r.randint(0, 9)) for k in r.sample(range(200), 80)]
    df = spark.createDataFrame(data, "g string, o long, at long, takes long")
    got = {(x.g, x.o): x._finish for x in scan.queued(df, ["g"], ["o"], scan.blocks("o", size), F.col("at"), F.col("takes")).collect()}
    done = {}
    for g, o, at, takes in sorted(data):
        done[g] = max(done.get(g, at), at) + takes
        assert got[g, o] == done[g]


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_nested_prefixes_read_little(spark, sf):
    """A prefix uses its input twice; running values of a chain that need no new order share one."""
    from tidemark.plans import queries as Q

    most = {"service_times": 2, "efficiency": 2, "watermark_advance": 4, "commit_ticks": 4, "queue_depth": 4, "active_keys_sweep": 8}
    assert {n: scans(Q.QUERIES[n](spark, sf)) for n in most} == most


def test_flushes_and_description(spark):
    from tidemark.operators import bandwidth

    df = spark.createDataFrame([(k, (k // 120) * 60_000_000) for k in range(300)], "offset long, read_us long")
    (r,) = bandwidth.aggregated(df, "read_us", "offset", F.col("first") == 50).collect()
    assert (r.hour, r.n_flushes, r.flushed, r.dropped) == (0, 8, 250, 50)
    commits = spark.createDataFrame([(7, 1, 20), (7, 0, 10), (8, 10, 3), (8, 2, 4)], "tick long, partition int, offset long")
    assert {x.tick: x.commits for x in watermark.described(commits).collect()} == {7: "[p0:10 p1:20]", 8: "[p2:4 p10:3]"}


def test_validation(spark):
    arrivals = [(0, 5), (0, 6), (0, 9), (0, 9), (0, 7), (0, -3), (0, 10), (1, -1), (1, 0)]
    df = spark.createDataFrame([(p, o, k) for k, (p, o) in enumerate(arrivals)], "partition int, offset long, arrival long")
    got = [(r.status, r.prev_offset, r.is_first) for r in sequence.validate(df, "arrival", scan.blocks("arrival", 2)).orderBy("arrival").collect()]
    assert got == [("ok", 4, True), ("ok", 5, False), ("ok", 6, False), ("duplicate", None, False), ("regression", None, False), ("negative", None, False), ("ok", 9, False), ("negative", None, False), ("ok", -1, True)]


def test_bucket_statistics(spark):
    rows = [(s, 10 * (s + 1), 100, False) for s in range(16)]
    df = spark.createDataFrame(rows, "second long, process_us long, e2e_us long, dead_letter boolean")
    stats = windows.buckets(df.withColumn("all", F.lit(1)), F.col("second"), "all")
    (r,) = windows.rollup(stats, 15, "all").collect()
    assert (r.n, r.total, r.avg_e2e_us, r.avg_process_us) == (15, 16, 100, sum(range(20, 170, 10)) // 15)
    gap = windows.window(stats.where("bucket in (0, 15)"), 15, "all").orderBy("bucket").collect()
    assert [x.n for x in gap] == [0] * 14 + [1]


def test_token_bucket(spark):
    times = [0, 0, 0, 0, 0, 100, 1000, 1000, 1000]
    df = spark.createDataFrame([(0, k, t) for k, t in enumerate(times)], "partition int, offset long, read_us long")
    for block in (2, 100):
        got = [r.release_us for r in windows.gcra(df, 10, 3, block).orderBy("offset").collect()]
        assert got == [0, 0, 0, 10, 20, 100, 1000, 1000, 1000]


def test_apply_outcomes(spark):
    def process(row):
        if row["offset"] % 3 == 1:
            raise ValueError("bad")

    def dead(row, reason):
        if row["offset"] == 7:
            raise OSError("full")

    df = spark.createDataFrame([(0, k, "k", 0) for k in range(10)], "partition int, offset long, key string, x int")
    got = {r.offset: r.status for r in outcomes.apply(sequence.lanes(df, 1), process, dead).collect()}
    assert got == {**{k: "ok" for k in range(7)}, 1: "dead_letter", 4: "dead_letter", 7: "halt", 8: "halt", 9: "halt"}


def test_repair_needs_proof(spark):
    state = spark.createDataFrame([(0, 9, 8), (1, 9, 8), (2, 9, 8)], "partition int, baseline long, last long")
    gap = spark.createDataFrame([(0, 11, 10), (0, 12, 8), (1, 11, 10), (2, 9, 8), (2, 10, 9)], "partition int, offset long, prev_offset long")
    got = {r.partition: (r.successor, r.n_orphaned) for r in watermark.repaired(state, gap).collect()}
    assert got == {0: (12, 1), 2: (9, 0)}


def test_config():
    c = Config(worker_shards=32, drain_timeout="2m", validate=False)
    assert c.drain_timeout == 120 and c.concurrent_keys == 250 and Config().trigger() == "5000 milliseconds"
    for bad in ({"worker_shards": 1}, {"worker_shards": 12, "validate": False}, {"concurrent_keys": 6000}, {"poll_timeout": 5}):
        with pytest.raises(ValueError):
            Config(**bad)
    assert seconds("1m30s") == 90 and seconds("250ms") == 0.25


def test_breaker_and_once():
    seen, b = [], lifecycle.Breaker()
    b.on_trip(seen.append)
    assert b.trip() and not b.trip("later") and b.reason == "unknown reason" and seen == [b.reason]
    calls = []
    once = lifecycle.Once(calls.append)
    assert once("a") and not once("b") and calls == ["a"]


def test_source_and_consumer(spark, tmp_path):
    spark.dataSource.register(MessageSource)
    ended = []

    def start():
        rows = spark.readStream.format("tidemark").option("partitions", 4).option("rows", 40).option("limit", 100).load()
        return rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).start()

    c = lifecycle.Consumer(start, Config(), ended.append)
    c.subscribe()
    c.shutdown()
    c.shutdown()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 100 and out.groupBy("partition").agg(F.max("offset").alias("m"), F.count("*").alias("n")).where("m = 24 and n = 25").count() == 4
    assert ended == [None]
    c.breaker.trip("x")
    with pytest.raises(RuntimeError):
        c.subscribe()


def test_committer_on_control_rows(spark, tmp_path):
    rows = [(0, 0, "assign", 100, 0, False, 0), (0, 1, "complete", 100, 99, False, 0), (0, 2, "complete", 105, 104, False, 0), (0, 3, "revoke", 0, 0, False, 0), (0, 4, "assign", 0, 0, False, 0), (0, 5, "complete", 150, 149, True, 0)]
    df = spark.createDataFrame(rows, "partition int, sequence long, event string, offset long, prev_offset long, is_first boolean, read_us long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = committer_job.commits(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    (r,) = spark.read.parquet(str(tmp_path / "out")).collect()
    assert (r.committed, r.n_completed, r.n_orphaned, r.gap_depth) == (150, 3, 2, 0)
    assert sorted(map(tuple, committer_job.orphan_rows(spark.read.parquet(str(tmp_path / "out"))).collect())) == [(0, 100), (0, 105)]


def test_dead_letters_come_before_commits(spark):
    log = []
    batch = spark.createDataFrame([(0, 1, "ok"), (0, 2, "dead_letter"), (0, 2, "dead_letter")], "partition int, offset long, status string")
    lifecycle.split(batch, lambda d: log.append(("dlq", d.count())), lambda d: log.append(("commit", d.first().offset)))
    assert log == [("dlq", 1), ("commit", 2)]
    with pytest.raises(outcomes.Halted):
        lifecycle.split(batch.union(spark.createDataFrame([(0, 3, "halt")], batch.schema)), lambda d: None, lambda d: log.append("never"))
    assert "never" not in log
    old = spark.createDataFrame([(0, 9), (1, 3)], "partition int, offset long")
    new = spark.createDataFrame([(0, 5), (2, 1)], "partition int, offset long")
    assert {tuple(r) for r in lifecycle.merged_commits(old, new).collect()} == {(0, 9), (1, 3), (2, 1)}


def test_benchmark_files(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"defaults": {"message_count": 100, "jitter": 0.1}, "runs": [{"concurrent_keys": 5}, {"concurrent_keys": 6, "jitter": 0.3}]}')
    got = {r.concurrent_keys: (r.message_count, r.jitter) for r in benchmark_runs(spark, str(tmp_path / "b.json")).collect()}
    assert got == {5: (100, 0.1), 6: (100, 0.3)}
    row = spark.createDataFrame([("t", 1, 2, 3, 0.5, 4, 5, 6.0, 7.0, 8.0)], "timestamp string, message_count long, concurrent_keys int, processor_latency_ms int, jitter double, num_partitions int, duration_ms long, actual_tps double, theoretical_tps double, efficiency_pct double")
    for _ in range(2):
        append_results(row, str(tmp_path / "csv"))
    assert benchmark_results(spark, str(tmp_path / "csv")).count() == 2
