import pytest
from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.operators import envelope
from tidemark.sources import MessageSource
from tidemark.streaming.builder import ConsumerBuilder

DF = "p int, o long, k string, topic string, v string"


def test_envelope(spark):
    df = spark.createDataFrame([(1, 2, "k", "t", "x")], DF)
    out = envelope.enrich(envelope.extract(df, "p", F.col("o") + 1, "k", {"a": F.col("v"), "b": F.lit(1)}), b=F.lit("new"), c=F.lit(3)).first()
    assert (out.partition, out.offset, out.key, out.ctx) == (1, 3, "k", {"a": "x", "b": "new", "c": "3"}) and out.payload.topic == "t"


def test_guard(spark):
    rows = lambda *topics: spark.createDataFrame([(1, k, "k", t, "x") for k, t in enumerate(topics)], DF)
    assert envelope.guard(rows("t", "", None), "t").count() == 3
    with pytest.raises(Exception, match="foreign topic: u"):
        envelope.guard(rows("t", "u"), "t").collect()


def test_builder_needs():
    for bad in (("", print, print), ("t", None, print), ("t", print, None)):
        with pytest.raises(ValueError):
            ConsumerBuilder(*bad)


def consumer(spark, tmp_path, process, dead, log):
    spark.dataSource.register(MessageSource)
    stream = spark.readStream.format("tidemark").option("partitions", 2).option("rows", 30).option("limit", 60).load()
    b = ConsumerBuilder("t", process, dead).config(Config()).enrich(zone=F.lit("z")).service("s", "team", "g").checkpoint(str(tmp_path / "c"))
    b.commit_sink(lambda df, n: log.append(("commit", n, sorted(map(tuple, df.collect())))))
    b.metrics_sink(lambda df, n: log.append(("metrics", n, sorted(df.columns), df.count())))
    b.bandwidth_sink(lambda df, n: 1 / 0)
    return b.shutdown_callback(lambda reason: log.append(("shutdown", reason))).build(stream, processingTime="0 seconds")


def test_consumer(spark, tmp_path):
    def process(row):
        assert row["ctx"]["zone"] == "z" if isinstance(row["ctx"], dict) else True
        if row["offset"] == 3:
            raise ValueError("x")

    log = []
    c = consumer(spark, tmp_path, process, lambda row, reason: None, log)
    c.subscribe()
    c.shutdown()
    commits = [x for x in log if x[0] == "commit"]
    assert [x[2] for x in commits] == [[(0, 14), (1, 14)], [(0, 29), (1, 29)]]
    columns = next(x[2] for x in log if x[0] == "metrics")
    assert not {"key", "payload", "ctx"} & set(columns) and {"traits", "status", "process_micros"} <= set(columns)
    assert log[-1] == ("shutdown", None)


def test_halt_commits_nothing(spark, tmp_path):
    def fail(*_):
        raise OSError("full")

    log = []
    c = consumer(spark, tmp_path, fail, fail, log)
    c.query = c._start()
    with pytest.raises(Exception, match="partition 0 at"):
        c.query.awaitTermination()
    assert not any(x[0] == "commit" for x in log)


def test_read_stamp(spark):
    out = envelope.stamped(envelope.extract(spark.createDataFrame([(1, 2, "k", "t", "x")], DF), "p", "o", "k"))
    assert out.first().read_us > 1_600_000_000_000_000 and envelope.stamped(out).columns == out.columns


def test_order_of_offsets_halts(spark):
    from tidemark.operators.outcomes import Halted

    log = []
    b = ConsumerBuilder("t", lambda row: None, lambda row, reason: None)
    b.commit_sink(lambda df, n: log.append(sorted(map(tuple, df.collect()))))
    rows = lambda *places: spark.createDataFrame([(p, o, "k") for p, o in places], "partition int, offset long, key string")
    b.batch(rows((0, 5), (0, 9), (1, 0)), 0)
    for bad in (((0, 9),), ((0, 3), (0, 10)), ((1, -1),), ((0, 10), (0, 10))):
        with pytest.raises(Halted):
            b.batch(rows(*bad), 1)
    b.batch(rows((0, 10), (2, 7)), 1)
    b.reset(0)
    b.batch(rows((0, 4)), 2)
    assert log == [[(0, 9), (1, 0)], [(0, 10), (2, 7)], [(0, 4)]]
    with pytest.raises(Exception, match="foreign topic: u"):
        b.batch(rows((0, 11)).withColumn("topic", F.lit("u")), 3)
