"""The query catalogue: each query and its SQL twin, over the stream in ``messages``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import fnv1a, trait_names
from tidemark.operators import bandwidth, epochs, outcomes, scan, sequence, watermark, windows
from tidemark.plans import messages as M

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

MESSAGES = """
m AS (
  SELECT (user_id % 12)::INT AS "partition", event_id AS "offset", user_id::VARCHAR AS key, epoch_us(ts) AS read_us,
         round(value * 100)::BIGINT * 100000 AS process_us, event_type = 'error' AS fails,
         event_type = 'error' AND event_id % 2 = 0 AS panics, event_type = 'error' AND event_id % 997 = 0 AS dl_fails, event_type, props
  FROM events)"""
SERVED = MESSAGES + """,
c AS (SELECT *, sum(process_us) OVER (PARTITION BY key ORDER BY "offset" ROWS UNBOUNDED PRECEDING)::BIGINT AS c FROM m),
s AS (SELECT * EXCLUDE (c), f::BIGINT AS finish_us, (f - process_us)::BIGINT AS start_us
      FROM (SELECT *, c + max(read_us - c + process_us) OVER (PARTITION BY key ORDER BY "offset" ROWS UNBOUNDED PRECEDING) AS f FROM c))"""
ADVANCED = SERVED + """,
a AS (SELECT *, max(finish_us) OVER (PARTITION BY "partition" ORDER BY "offset" ROWS UNBOUNDED PRECEDING) AS watermark_us FROM s)"""


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH {MESSAGES} SELECT "partition", "offset", key, read_us, 'events' AS topic, 'tidemark' AS consumer_group, 'analytics' AS service,
  event_type AS ctx_type, json_extract_string(props, '$.k')::INT AS ctx_k FROM m""")
def envelope_projection(spark, sf_dir):
    m = M.messages(spark, sf_dir)
    return m.select("partition", "offset", "key", "read_us", F.lit("events").alias("topic"), F.lit("tidemark").alias("consumer_group"), F.lit("analytics").alias("service"), F.col("event_type").alias("ctx_type"), F.get_json_object("props", "$.k").cast("int").alias("ctx_k"))


def disturbed(m: DataFrame) -> DataFrame:
    """Arrivals with repeated, older and negative offsets between the real ones."""
    rows = m.select("partition", "offset", (F.col("offset") * 4).alias("arrival"))
    extra = [rows.where(F.col("offset") % 500 == 0).withColumn("arrival", F.col("arrival") + 1), rows.where((F.col("offset") % 700 == 0) & (F.col("offset") > 40)).withColumn("arrival", F.col("arrival") + 2).withColumn("offset", F.col("offset") - 36), rows.where(F.col("offset") % 900 == 0).withColumn("arrival", F.col("arrival") + 3).withColumn("offset", -F.col("offset") - 1)]
    for e in extra:
        rows = rows.union(e)
    return rows


DISTURBED = MESSAGES + """,
d AS (SELECT "partition", "offset", "offset" * 4 AS arrival FROM m
  UNION ALL SELECT "partition", "offset", "offset" * 4 + 1 FROM m WHERE "offset" % 500 = 0
  UNION ALL SELECT "partition", "offset" - 36, "offset" * 4 + 2 FROM m WHERE "offset" % 700 = 0 AND "offset" > 40
  UNION ALL SELECT "partition", -"offset" - 1, "offset" * 4 + 3 FROM m WHERE "offset" % 900 = 0)"""


@query(f"""WITH {DISTURBED}, x AS (
  SELECT *, max(CASE WHEN "offset" >= 0 THEN "offset" END) OVER (PARTITION BY "partition" ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM d)
SELECT "partition", "offset", arrival,
  CASE WHEN "offset" < 0 THEN 'negative' WHEN seen IS NULL OR "offset" > seen THEN 'ok' WHEN "offset" = seen THEN 'duplicate' ELSE 'regression' END AS status,
  "offset" >= 0 AND seen IS NULL AS is_first,
  CASE WHEN "offset" >= 0 AND (seen IS NULL OR "offset" > seen) THEN coalesce(seen, "offset" - 1) END AS prev_offset FROM x""")
def seq_validate(spark, sf_dir):
    return sequence.validate(disturbed(M.messages(spark, sf_dir)), "arrival")


@query(f"""WITH {MESSAGES} SELECT "partition", "offset", coalesce(lag("offset") OVER w, "offset" - 1) AS prev_offset, lag("offset") OVER w IS NULL AS is_first
  FROM m WINDOW w AS (PARTITION BY "partition" ORDER BY "offset")""")
def prev_offset_chain(spark, sf_dir):
    return sequence.predecessors(M.messages(spark, sf_dir).select("partition", "offset"))


@query(f"""WITH {MESSAGES}, o AS (SELECT "partition", "offset", ((read_us // {M.DAY} + "partition") // 7)::BIGINT AS epoch FROM m WHERE (read_us // {M.DAY} + "partition") % 7 <> 0)
SELECT "partition", "offset", epoch, coalesce(lag("offset") OVER w, "offset" - 1) AS prev_offset, lag("offset") OVER w IS NULL AS is_first FROM o WINDOW w AS (PARTITION BY "partition", epoch ORDER BY "offset")""")
def predecessor_reset(spark, sf_dir):
    """Predecessors of owned messages; each assignment starts anew."""
    day = F.floor(F.col("read_us") / M.DAY) + F.col("partition")
    m = M.messages(spark, sf_dir).where(day % 7 != 0).select("partition", "offset", F.floor(day / 7).cast("long").alias("epoch"))
    return sequence.predecessors(m, epoch="epoch")


@query(f"""WITH {MESSAGES}, p AS (SELECT "partition", "offset", lag("offset") OVER (PARTITION BY "partition" ORDER BY "offset") AS prev FROM m)
SELECT "partition", count(*) AS n_gaps, max("offset" - prev - 1)::BIGINT AS widest, sum("offset" - prev - 1)::BIGINT AS n_missing FROM p WHERE "offset" - prev > 1 GROUP BY "partition" """)
def broker_gaps(spark, sf_dir):
    p = sequence.predecessors(M.messages(spark, sf_dir).select("partition", "offset"))
    gap = F.col("offset") - F.col("prev_offset") - 1
    return p.where(gap > 0).groupBy("partition").agg(F.count("*").alias("n_gaps"), F.max(gap).alias("widest"), F.sum(gap).alias("n_missing"))


FNV = """list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(key, ''), lambda ch: ascii(ch)::BIGINT)), lambda h, b: (xor(h, b) * 16777619) % 4294967296)"""


@query(f"""WITH {MESSAGES}, k AS (SELECT DISTINCT key FROM m), f AS (SELECT key, {FNV} AS fnv FROM k) SELECT key, fnv, (fnv & 15)::INT AS shard FROM f""")
def shard_index(spark, sf_dir):
    keys = M.messages(spark, sf_dir).select("key").distinct()
    return sequence.sharded(keys.withColumn("fnv", fnv1a("key")), M.SHARDS)


@query(f"""WITH {MESSAGES}, k AS (SELECT key, count(*) AS n FROM m GROUP BY key), f AS (SELECT n, ({FNV} & 15)::INT AS shard FROM k)
SELECT shard, count(*) AS n_keys, sum(n)::BIGINT AS n_messages FROM f GROUP BY shard""")
def shard_load(spark, sf_dir):
    keys = M.messages(spark, sf_dir).groupBy("key").agg(F.count("*").alias("n"))
    return sequence.sharded(keys, M.SHARDS).groupBy("shard").agg(F.count("*").alias("n_keys"), F.sum("n").alias("n_messages"))


@query(f"""WITH {MESSAGES} SELECT key, "partition", "offset", row_number() OVER (PARTITION BY key ORDER BY "offset") AS lane_rank FROM m""")
def key_lane_rank(spark, sf_dir):
    m = M.messages(spark, sf_dir).select("key", "partition", "offset")
    return scan.prefix(m, ["key"], ["offset"], scan.blocks("offset"), lane_rank=("sum", F.lit(1)))


STATUS = "CASE WHEN NOT fails THEN 'ok' WHEN dl_fails THEN 'halt' ELSE 'dead_letter' END"
BITS = '(CASE WHEN panics THEN 2 ELSE 0 END) + (CASE WHEN fails AND NOT panics THEN 4 ELSE 0 END) + (CASE WHEN fails AND NOT dl_fails THEN 8 ELSE 0 END)'


@query(f"""WITH {MESSAGES} SELECT "partition", "offset", {STATUS} AS status, CASE WHEN panics THEN 'panic' WHEN fails THEN 'error' END AS error, ({BITS})::BIGINT AS traits FROM m""")
def outcome_classify(spark, sf_dir):
    return outcomes.classify(M.messages(spark, sf_dir)).select("partition", "offset", "status", "error", "traits")


@query(f"""WITH {MESSAGES} SELECT "partition", "offset", key, CASE WHEN panics THEN 'panic' ELSE 'error' END AS reason FROM m WHERE fails AND NOT dl_fails""")
def dead_letters(spark, sf_dir):
    return outcomes.dead_letters(outcomes.classify(M.messages(spark, sf_dir)))


@query(f"""WITH {MESSAGES}, h AS (SELECT min("offset") AS halt FROM m WHERE dl_fails)
SELECT "partition", max(CASE WHEN "offset" < halt THEN "offset" END) AS last_offset, count(CASE WHEN "offset" >= halt THEN 1 END) AS n_not_processed, any_value(halt) AS halt_offset FROM m, h GROUP BY "partition" """)
def halt_point(spark, sf_dir):
    return outcomes.halted(outcomes.classify(M.messages(spark, sf_dir)))


@query(f"""WITH {MESSAGES}, t AS (SELECT ({BITS})::BIGINT AS traits FROM m) SELECT traits, count(*) AS n,
  array_to_string(list_filter([CASE WHEN traits & 2 <> 0 THEN 'process_panic' END, CASE WHEN traits & 4 <> 0 THEN 'process_error' END, CASE WHEN traits & 8 <> 0 THEN 'dead_letter' END], lambda x: x IS NOT NULL), ',') AS names FROM t GROUP BY traits""")
def traits_rollup(spark, sf_dir):
    rows = outcomes.classify(M.messages(spark, sf_dir)).groupBy("traits").agg(F.count("*").alias("n"))
    return rows.withColumn("names", F.array_join(trait_names(F.col("traits"), M.TRAITS), ","))


@query(f"""WITH {SERVED} SELECT key, "partition", "offset", read_us, start_us, finish_us FROM s""")
def service_times(spark, sf_dir):
    return M.served(M.messages(spark, sf_dir)).select("key", "partition", "offset", "read_us", "start_us", "finish_us")


@query(f"""WITH {SERVED} SELECT "partition", "offset", key, (SELECT count(*) FROM s b WHERE b.key = s.key AND b."offset" < s."offset" AND b.start_us > s.read_us) AS queue_depth FROM s""")
def queue_depth(spark, sf_dir):
    return windows.queue_depths(M.served(M.messages(spark, sf_dir)))


SWEEP = SERVED + """,
r AS (SELECT *, sum(CASE WHEN start_us = read_us THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY "offset" ROWS UNBOUNDED PRECEDING) AS run FROM s),
p AS (SELECT key, min(start_us) AS from_us, max(finish_us) AS to_us FROM r GROUP BY key, run),
e AS (SELECT at_us, sum(step) AS step FROM (SELECT from_us AS at_us, 1 AS step FROM p UNION ALL SELECT to_us, -1 FROM p) GROUP BY at_us),
w AS (SELECT at_us, sum(step) OVER (ORDER BY at_us ROWS UNBOUNDED PRECEDING)::BIGINT AS active FROM e)"""


@query(f"WITH {SWEEP} SELECT (at_us // 3600000000)::BIGINT AS hour, max(active) AS most_active, min(active) AS least_active FROM w GROUP BY 1")
def active_keys_sweep(spark, sf_dir):
    a = windows.sweep(windows.busy_periods(M.served(M.messages(spark, sf_dir))), M.DAY)
    return a.groupBy(F.floor(F.col("at_us") / M.HOUR).cast("long").alias("hour")).agg(F.max("active").alias("most_active"), F.min("active").alias("least_active"))


@query(f"""WITH {SWEEP} SELECT count(*) AS n_changes, count(CASE WHEN active > 4 THEN 1 END) AS n_over, max(active) AS most_active FROM w""")
def overflow_estimate(spark, sf_dir):
    a = windows.sweep(windows.busy_periods(M.served(M.messages(spark, sf_dir))), M.DAY)
    return a.agg(F.count("*").alias("n_changes"), F.count(F.when(F.col("active") > 4, 1)).alias("n_over"), F.max("active").alias("most_active"))


@query(f"""WITH {MESSAGES}, x AS (SELECT *, min(CASE WHEN fails THEN 0 ELSE 1 END) OVER (PARTITION BY "partition" ORDER BY "offset" ROWS UNBOUNDED PRECEDING) AS whole FROM m)
SELECT "partition", max(CASE WHEN whole = 1 THEN "offset" END) AS ready_offset, max("offset") AS max_offset_seen, count(CASE WHEN whole = 0 AND NOT fails THEN 1 END) AS gap_depth FROM x GROUP BY "partition" """)
def watermark_by_partition(spark, sf_dir):
    return watermark.ready(M.messages(spark, sf_dir), ~F.col("fails"))


@query(f"""WITH {MESSAGES}, x AS (SELECT *, min(CASE WHEN fails THEN 0 ELSE 1 END) OVER (PARTITION BY "partition" ORDER BY "offset" ROWS UNBOUNDED PRECEDING) AS whole FROM m)
SELECT "partition", "offset", key FROM x WHERE whole = 0 AND NOT fails""")
def gap_buffer(spark, sf_dir):
    return watermark.gap_buffer(M.messages(spark, sf_dir), ~F.col("fails")).select("partition", "offset", "key")


@query(f"""WITH {ADVANCED} SELECT "partition", "offset", finish_us, watermark_us FROM a""")
def watermark_advance(spark, sf_dir):
    return M.advanced(M.messages(spark, sf_dir)).select("partition", "offset", "finish_us", "watermark_us")


@query(f"""WITH {ADVANCED} SELECT "partition", count(*) AS n, count(CASE WHEN watermark_us > finish_us THEN 1 END) AS n_buffered, max(watermark_us - finish_us) AS longest_us FROM a GROUP BY "partition" """)
def commit_buffered(spark, sf_dir):
    a = M.advanced(M.messages(spark, sf_dir))
    wait = F.col("watermark_us") - F.col("finish_us")
    return a.groupBy("partition").agg(F.count("*").alias("n"), F.count(F.when(wait > 0, 1)).alias("n_buffered"), F.max(wait).alias("longest_us"))


TICKS = ADVANCED + f""", t AS (SELECT "partition", ((watermark_us + {M.TICK - 1}) // {M.TICK})::BIGINT AS tick, max("offset") AS "offset" FROM a GROUP BY 1, 2)"""


@query(f"WITH {TICKS} SELECT * FROM t")
def commit_ticks(spark, sf_dir):
    return watermark.commits(M.advanced(M.messages(spark, sf_dir)), M.TICK)


@query(f"""WITH {TICKS} SELECT tick, '[' || string_agg('p' || "partition" || ':' || "offset", ' ' ORDER BY "partition") || ']' AS commits FROM t GROUP BY tick""")
def commit_description(spark, sf_dir):
    return watermark.described(watermark.commits(M.advanced(M.messages(spark, sf_dir)), M.TICK))


@query(f"""WITH {TICKS}, x AS (SELECT *, lag("offset") OVER (PARTITION BY "partition" ORDER BY tick) AS before FROM t)
SELECT "partition", count(*) AS n_commits, max("offset") AS highest, count(CASE WHEN before >= "offset" THEN 1 END) AS n_not_increasing FROM x GROUP BY "partition" """)
def commit_monotonic_check(spark, sf_dir):
    t = scan.prefix(watermark.commits(M.advanced(M.messages(spark, sf_dir)), M.TICK), ["partition"], ["tick"], scan.blocks("tick"), _before=("last_before", F.col("offset")))
    return t.groupBy("partition").agg(F.count("*").alias("n_commits"), F.max("offset").alias("highest"), F.count(F.when(F.col("_before") >= F.col("offset"), 1)).alias("n_not_increasing"))


@query(f"""WITH {ADVANCED}, d AS (SELECT unnest(range((SELECT min(read_us) // {M.DAY} FROM m)::BIGINT, (SELECT max(finish_us) // {M.DAY} + 2 FROM s)::BIGINT)) AS day)
SELECT day, count(*) AS n_redelivered FROM d JOIN a ON finish_us <= day * {M.DAY} AND ((watermark_us + {M.TICK - 1}) // {M.TICK}) * {M.TICK} > day * {M.DAY} GROUP BY day""")
def redelivery_bound(spark, sf_dir):
    """Messages finished but not committed at each midnight: what a crash there would process again."""
    a = M.advanced(M.messages(spark, sf_dir))
    first = F.ceil(F.col("finish_us") / M.DAY).cast("long")
    last = F.ceil(watermark.tick_of("watermark_us", M.TICK) * M.TICK / M.DAY).cast("long") - 1
    return a.where(first <= last).select(F.explode(F.sequence(first, last)).alias("day")).groupBy("day").agg(F.count("*").alias("n_redelivered"))


@query(f"""WITH {MESSAGES}, x AS (SELECT "partition", "offset", read_us, 0 AS twin FROM m UNION ALL SELECT "partition", "offset", read_us + 1000000, 1 FROM m WHERE "offset" % 10 = 0)
SELECT "partition", "offset", read_us, twin FROM (SELECT *, row_number() OVER (PARTITION BY "partition", "offset" ORDER BY read_us DESC) AS k FROM x) WHERE k = 1""")
def gap_dedupe(spark, sf_dir):
    m = M.messages(spark, sf_dir).select("partition", "offset", "read_us", F.lit(0).alias("twin"))
    twins = m.where(F.col("offset") % 10 == 0).withColumn("read_us", F.col("read_us") + 1_000_000).withColumn("twin", F.lit(1))
    return sequence.latest_twins(m.union(twins)).select("partition", "offset", "read_us", "twin")


@query(f"""WITH {MESSAGES} SELECT "partition", count(*) AS n_owned, max("offset") AS highest FROM m WHERE (read_us // {M.DAY} + "partition") % 7 <> 0 GROUP BY "partition" """)
def ownership_filter(spark, sf_dir):
    m = M.messages(spark, sf_dir)
    return epochs.owned(m, epochs.control(m)).groupBy("partition").agg(F.count("*").alias("n_owned"), F.max("offset").alias("highest"))


@query(f"""WITH {SERVED}, x AS (SELECT *, (read_us // {M.DAY} + "partition") AS d0, (finish_us // {M.DAY} + "partition") AS d1 FROM s)
SELECT "partition", count(*) AS n, count(CASE WHEN NOT (d0 % 7 <> 0 AND d1 % 7 <> 0 AND d0 // 7 = d1 // 7) THEN 1 END) AS n_orphaned FROM x GROUP BY "partition" """)
def orphans_by_epoch(spark, sf_dir):
    m = M.messages(spark, sf_dir)
    return epochs.marked(M.served(m), epochs.control(m)).groupBy("partition").agg(F.count("*").alias("n"), F.count(F.when(F.col("orphaned"), 1)).alias("n_orphaned"))


@query(f"""WITH {MESSAGES}, h AS (SELECT "partition", min(CASE WHEN fails THEN "offset" END) AS hole FROM m GROUP BY 1),
st AS (SELECT m."partition", max("offset") + 1 AS baseline, max("offset") AS last FROM m JOIN h USING ("partition") WHERE hole IS NULL OR "offset" < hole GROUP BY 1),
g AS (SELECT "partition", "offset", lag("offset") OVER (PARTITION BY "partition" ORDER BY "offset") AS prev FROM m WHERE NOT fails),
b AS (SELECT g.* FROM g JOIN st USING ("partition") WHERE "offset" > last AND ("partition" % 3 <> 0 OR "offset" % 5 = 0)),
f AS (SELECT b."partition", min("offset") AS successor FROM b JOIN st USING ("partition") WHERE "offset" >= baseline AND ("offset" = baseline OR prev BETWEEN 0 AND last) GROUP BY 1)
SELECT "partition", any_value(successor) AS successor, count(CASE WHEN b."offset" < successor THEN 1 END) AS n_orphaned FROM b JOIN f USING ("partition") GROUP BY "partition" """)
def repair_successor(spark, sf_dir):
    """Partitions stalled at their first failed message, which then vanishes: the next message's predecessor proves it."""
    m = M.messages(spark, sf_dir)
    last = watermark.ready(m, ~F.col("fails")).where("ready_offset is not null")
    state = last.select("partition", (F.col("ready_offset") + 1).alias("baseline"), F.col("ready_offset").alias("last"))
    gap = sequence.predecessors(m.where(~F.col("fails")).select("partition", "offset")).join(state.select("partition", "last"), "partition")
    gap = gap.where((F.col("offset") > F.col("last")) & ((F.col("partition") % 3 != 0) | (F.col("offset") % 5 == 0))).select("partition", "offset", "prev_offset")
    return watermark.repaired(state, gap)


STATS = f"""count(*) AS n, count(CASE WHEN fails THEN 1 END) AS n_dead_letters, sum(process_us)::BIGINT AS sum_process_us, max(process_us) AS max_process_us,
  sum(watermark_us - read_us)::BIGINT AS sum_e2e_us, max(watermark_us - read_us) AS max_e2e_us, min(watermark_us - read_us) AS min_e2e_us"""


def finished(spark, sf_dir):
    a = M.advanced(M.messages(spark, sf_dir))
    return a.select("partition", "offset", "process_us", "finish_us", "watermark_us", F.col("fails").alias("dead_letter"), (F.col("watermark_us") - F.col("read_us")).alias("e2e_us"))


def hour(us):
    return F.floor(F.col(us) / M.HOUR).cast("long")


@query(f"WITH {ADVANCED} SELECT (finish_us // {M.HOUR})::BIGINT AS bucket, {STATS} FROM a GROUP BY 1")
def throughput_windows(spark, sf_dir):
    return windows.buckets(finished(spark, sf_dir), hour("finish_us"))


ROLLUP = ADVANCED + f""", b AS (SELECT "partition", (finish_us // {M.HOUR})::BIGINT AS bucket, {STATS} FROM a GROUP BY 1, 2),
nw AS (SELECT "partition", max(bucket) AS newest, sum(n)::BIGINT AS total FROM b GROUP BY 1)"""


@query(f"""WITH {ROLLUP}, x AS (SELECT "partition", any_value(newest) AS newest, any_value(total) AS total, sum(n)::BIGINT AS n, sum(n_dead_letters)::BIGINT AS n_dead_letters, sum(sum_process_us)::BIGINT AS sum_process_us, sum(sum_e2e_us)::BIGINT AS sum_e2e_us,
  max(max_e2e_us) AS max_e2e_us, min(min_e2e_us) AS min_e2e_us FROM b JOIN nw USING ("partition") WHERE bucket > newest - 15 GROUP BY 1)
SELECT *, CASE WHEN n > 0 THEN sum_process_us // n END AS avg_process_us, CASE WHEN n > 0 THEN sum_e2e_us // n END AS avg_e2e_us FROM x""")
def window_rollup(spark, sf_dir):
    return windows.rollup(windows.buckets(finished(spark, sf_dir), hour("finish_us"), "partition"), 15, "partition")


@query(f"""WITH {ROLLUP}, p AS (SELECT "partition", newest, unnest(range(15)) AS position FROM nw)
SELECT p."partition", position, (newest - position) * {M.HOUR} AS from_us, (newest - position) * {M.HOUR} + {M.HOUR - 1000} AS to_us, coalesce(n, 0) AS processed, coalesce(n_dead_letters, 0) AS dead_letters
FROM p LEFT JOIN b ON b."partition" = p."partition" AND b.bucket = newest - position""")
def window_list(spark, sf_dir):
    """The last 15 hours of each partition, newest first, with their times."""
    return windows.listed(windows.buckets(finished(spark, sf_dir), hour("finish_us"), "partition"), 15, M.HOUR, "partition")


@query(f"""WITH {ADVANCED}, x AS (SELECT *, max(finish_us // {M.HOUR}) OVER (PARTITION BY "partition" ORDER BY "offset" ROWS UNBOUNDED PRECEDING) AS bucket, finish_us // {M.HOUR} AS own FROM a)
SELECT "partition", bucket::BIGINT AS bucket, count(*) AS n, count(CASE WHEN own < bucket THEN 1 END) AS n_late FROM x GROUP BY 1, 2""")
def late_to_current_bucket(spark, sf_dir):
    """Rows processed in an older bucket than one that the watermark has passed count in the current one."""
    rows = finished(spark, sf_dir).withColumn("own", hour("finish_us"))
    rows = scan.prefix(rows, ["partition"], ["offset"], scan.blocks("offset"), bucket=("max", F.col("own")))
    return rows.groupBy("partition", "bucket").agg(F.count("*").alias("n"), F.count(F.when(F.col("own") < F.col("bucket"), 1)).alias("n_late"))



def snapshot_rows(spark, sf_dir):
    a = M.advanced(M.messages(spark, sf_dir))
    at = a.agg(F.expr("min(read_us) + (max(read_us) - min(read_us)) div 2").alias("at_us"))
    a = a.crossJoin(at).where("read_us <= at_us")  # one row on the right
    tick = watermark.tick_of("watermark_us", M.TICK) * M.TICK
    ready = F.max(F.when(F.col("watermark_us") <= F.col("at_us"), F.col("offset")))
    committed = F.max(F.when(tick <= F.col("at_us"), F.col("offset")))
    rows = a.groupBy("partition").agg(F.greatest(F.coalesce(committed, F.lit(-1)), F.lit(-1)).alias("committed"), ready.alias("_ready"), F.max("offset").alias("max_offset_seen"), F.count(F.when((F.col("finish_us") <= F.col("at_us")) & (F.col("watermark_us") > F.col("at_us")), 1)).alias("gap_depth"), F.max((F.floor(F.col("at_us") / M.DAY) + F.col("partition")) % 7 != 0).alias("assigned"))
    return rows.select("partition", "committed", F.coalesce("_ready", "committed").alias("ready"), "max_offset_seen", "gap_depth", "assigned")


SNAPSHOT = f"""{ADVANCED}, t AS (SELECT (min(read_us) + (max(read_us) - min(read_us)) // 2)::BIGINT AS at_us FROM a),
x AS (SELECT a.*, at_us FROM a, t WHERE read_us <= at_us),
y AS (SELECT "partition", coalesce(max(CASE WHEN ((watermark_us + {M.TICK - 1}) // {M.TICK}) * {M.TICK} <= at_us THEN "offset" END), -1) AS committed, max(CASE WHEN watermark_us <= at_us THEN "offset" END) AS r,
  max("offset") AS max_offset_seen, count(CASE WHEN finish_us <= at_us AND watermark_us > at_us THEN 1 END) AS gap_depth, bool_or((at_us // {M.DAY} + "partition") % 7 <> 0) AS assigned FROM x GROUP BY 1),
z AS (SELECT "partition", committed, coalesce(r, committed) AS ready, max_offset_seen, gap_depth, assigned FROM y)"""


@query(f"WITH {SNAPSHOT} SELECT * FROM z")
def precommit_snapshot(spark, sf_dir):
    """State of every partition at the middle of the stream."""
    return snapshot_rows(spark, sf_dir)


@query(f"""WITH {SNAPSHOT} SELECT '{{"assigned":' || count(CASE WHEN assigned THEN 1 END) || ',"buffered":' || sum(gap_depth) || ',"partitions":['
  || string_agg('{{"partition":' || "partition" || ',"committed":' || committed || ',"ready":' || ready || ',"max_offset_seen":' || max_offset_seen || ',"gap_depth":' || gap_depth || ',"assigned":' || assigned || '}}', ',' ORDER BY "partition") || ']}}' AS document FROM z""")
def snapshot_json(spark, sf_dir):
    """The same as one JSON document; its list is as long as the stream has partitions."""
    rows = snapshot_rows(spark, sf_dir)
    listed = F.sort_array(F.collect_list(F.struct("partition", "committed", "ready", "max_offset_seen", "gap_depth", "assigned")))
    return rows.agg(F.to_json(F.struct(F.count(F.when(F.col("assigned"), 1)).alias("assigned"), F.sum("gap_depth").alias("buffered"), listed.alias("partitions"))).alias("document"))


@query(f"""WITH {MESSAGES} SELECT count(CASE WHEN "offset" % 101 <> 0 THEN 1 END) AS collected, count(CASE WHEN "offset" % 101 = 0 THEN 1 END) AS dropped, count(CASE WHEN "offset" % 101 <> 0 AND panics THEN 1 END) AS send_failed FROM m""")
def metrics_stats(spark, sf_dir):
    m, drop = M.messages(spark, sf_dir), F.col("offset") % 101 == 0
    return m.agg(F.count_if(~drop).alias("collected"), F.count_if(drop).alias("dropped"), F.count_if(~drop & F.col("panics")).alias("send_failed"))


@query(f"""WITH {ADVANCED} SELECT "partition", "offset", ({BITS})::BIGINT + CASE WHEN watermark_us > finish_us THEN 32 ELSE 0 END AS traits, process_us, start_us, read_us, watermark_us, ({FNV} & 15)::INT AS shard FROM a""")
def metrics_projection(spark, sf_dir):
    """One metrics row a message; by rule without key and payload."""
    rows = sequence.sharded(outcomes.classify(M.advanced(M.messages(spark, sf_dir))), M.SHARDS)
    buffered = F.when(F.col("watermark_us") > F.col("finish_us"), M.TRAITS["commit_buffered"]).otherwise(0)
    return rows.select("partition", "offset", (F.col("traits") + buffered).alias("traits"), "process_us", "start_us", "read_us", "watermark_us", "shard")


@query(f"""WITH {MESSAGES}, x AS (SELECT read_us // 60000000 AS tick, row_number() OVER (PARTITION BY read_us // 3600000000 ORDER BY "offset") AS k, read_us // 3600000000 AS hour FROM m)
SELECT hour::BIGINT AS tick, ((k - 1) // 5)::BIGINT AS flush, count(*) AS n_packets FROM x GROUP BY 1, 2""")
def bandwidth_packets(spark, sf_dir):
    """Flushes of a buffer at every fifth packet or the hour's end."""
    m = M.messages(spark, sf_dir).select("offset", hour("read_us").alias("tick"))
    return bandwidth.flushes(m, "tick", "offset", 5).drop("first")


@query(f"""WITH {MESSAGES}, x AS (SELECT "offset", read_us // 60000000 AS tick, row_number() OVER (PARTITION BY read_us // 60000000 ORDER BY "offset") AS k FROM m),
f AS (SELECT tick, (k - 1) // 50 AS flush, count(*) AS n, min("offset") AS first FROM x GROUP BY 1, 2)
SELECT (tick // 60)::BIGINT AS hour, count(*) AS n_flushes, coalesce(sum(CASE WHEN first % 7 <> 0 THEN n END), 0)::BIGINT AS flushed, coalesce(sum(CASE WHEN first % 7 = 0 THEN n END), 0)::BIGINT AS dropped FROM f GROUP BY 1""")
def bandwidth_flushes(spark, sf_dir):
    """The buffer flushed each minute or at 50 packets; the sink fails for batches that begin at every seventh offset."""
    return bandwidth.aggregated(M.messages(spark, sf_dir).select("offset", "read_us"), "read_us", "offset", F.col("first") % 7 == 0)


@query(f"""WITH {MESSAGES} SELECT "partition", (read_us // {M.DAY})::BIGINT AS day, count(*) AS received_messages, sum(strlen(props))::BIGINT AS received_bytes FROM m GROUP BY 1, 2""")
def bandwidth_rollup(spark, sf_dir):
    m = M.messages(spark, sf_dir)
    return bandwidth.received(m.withColumn("day", F.floor(F.col("read_us") / M.DAY).cast("long")), "props", "partition", "day")


def released(interval: int, burst: int) -> str:
    return f"""WITH {MESSAGES}, i AS (SELECT *, row_number() OVER (PARTITION BY "partition" ORDER BY "offset") - 1 AS i FROM m),
t AS (SELECT *, max(read_us - i * {interval}) OVER (PARTITION BY "partition" ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + i * {interval} AS tat FROM i)
SELECT "partition", "offset", greatest(read_us, coalesce(tat - {(burst - 1) * interval}, read_us))::BIGINT AS release_us FROM t"""


@query(released(3_600_000_000, 4))
def token_bucket_release(spark, sf_dir):
    return windows.gcra(M.messages(spark, sf_dir), 3_600_000_000, 4).select("partition", "offset", "release_us")


@query(released(3_000_000_000, 1))
def ticker_release(spark, sf_dir):
    return windows.gcra(M.messages(spark, sf_dir), 3_000_000_000, 1).select("partition", "offset", "release_us")


@query(f"""WITH {SERVED}, x AS (SELECT min(start_us) AS from_us, max(finish_us) AS to_us, count(*) AS n, count(DISTINCT key) AS keys, sum(process_us)::BIGINT AS busy, sum(finish_us - read_us)::BIGINT AS e2e FROM s)
SELECT n, to_us - from_us AS span_us, round(n * 1e6::DOUBLE / (to_us - from_us), 6) AS actual_tps, round(keys * 1e6::DOUBLE * n / busy, 6) AS theoretical_tps,
  CASE WHEN busy = 0 THEN -1.0::DOUBLE ELSE round(100.0::DOUBLE * (n * 1e6::DOUBLE / (to_us - from_us)) / (keys * 1e6::DOUBLE * n / busy), 6) END AS efficiency_pct, busy // n AS avg_process_us, e2e // n AS avg_e2e_us FROM x""")
def efficiency(spark, sf_dir):
    return bandwidth.efficiency(M.served(M.messages(spark, sf_dir)))


BENCH = """r AS (SELECT p_size % 5 * 10 AS latency_ms, (p_partkey % 4 + 1)::INT * 250 AS keys, p_retailprice AS tps FROM part), f AS (SELECT latency_ms, keys, tps, CASE WHEN latency_ms > 0 THEN 100.0::DOUBLE * tps / (keys * 1000.0::DOUBLE / latency_ms) ELSE -1.0::DOUBLE END AS eff FROM r)"""


def bench_rows(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    r = p.select((F.col("p_size") % 5 * 10).alias("latency_ms"), ((F.col("p_partkey") % 4 + 1).cast("int") * 250).alias("keys"), F.col("p_retailprice").alias("tps"))
    return bandwidth.with_efficiency(r)


@query(f"""WITH {BENCH} SELECT latency_ms, count(*) AS n_runs, round(min(tps), 4) AS min_tps, round(max(tps), 4) AS max_tps, round(sum(tps) / count(*), 4) AS avg_tps, round(1e6 / max(tps), 6) AS overhead_us FROM f GROUP BY latency_ms""")
def bench_matrix(spark, sf_dir):
    return bench_rows(spark, sf_dir).groupBy("latency_ms").agg(F.count("*").alias("n_runs"), F.round(F.min("tps"), 4).alias("min_tps"), F.round(F.max("tps"), 4).alias("max_tps"), F.round(F.sum("tps") / F.count("*"), 4).alias("avg_tps"), F.round(F.lit(1e6) / F.max("tps"), 6).alias("overhead_us"))


@query(f"""WITH {BENCH}, g AS (SELECT keys, latency_ms, round(sum(eff) / count(*), 4) AS v FROM f WHERE latency_ms <> 0 AND latency_ms <> 10 AND eff >= 0 GROUP BY 1, 2)
SELECT keys, max(CASE WHEN latency_ms = 20 THEN v END) AS ms_20, max(CASE WHEN latency_ms = 30 THEN v END) AS ms_30, max(CASE WHEN latency_ms = 40 THEN v END) AS ms_40 FROM g GROUP BY keys""")
def heatmap(spark, sf_dir):
    rows = bench_rows(spark, sf_dir).where("latency_ms not in (0, 10) and eff >= 0")
    wide = rows.groupBy("keys").pivot("latency_ms", [20, 30, 40]).agg(F.round(F.sum("eff") / F.count("eff"), 4))
    return wide.select("keys", *[F.col(str(k)).alias(f"ms_{k}") for k in (20, 30, 40)])


@query(f"""WITH {MESSAGES}, x AS (SELECT "partition", "offset" FROM m UNION ALL SELECT "partition", "offset" FROM m WHERE "offset" % 50 = 0)
SELECT "partition", count(*) AS n_delivered, count(DISTINCT "offset") AS n_distinct, count(*) - count(DISTINCT "offset") AS n_repeated FROM x GROUP BY 1""")
def distinct_offsets_complete(spark, sf_dir):
    m = M.messages(spark, sf_dir).select("partition", "offset")
    twice = m.union(m.where(F.col("offset") % 50 == 0))
    each = twice.groupBy("partition", "offset").agg(F.count("*").alias("n"))
    return each.groupBy("partition").agg(F.sum("n").alias("n_delivered"), F.count("*").alias("n_distinct"), (F.sum("n") - F.count("*")).alias("n_repeated"))


@query(f"""WITH {ADVANCED} SELECT "partition", max("offset") AS committed, count(*) AS n_completed FROM a GROUP BY 1""")
def committer_stream(spark, sf_dir):
    """Completions, in order of finishing, through the streaming committer; the last commit of each partition."""
    from tidemark.streaming import committer_job

    return committer_job.committed(spark, M.served(M.messages(spark, sf_dir)))



