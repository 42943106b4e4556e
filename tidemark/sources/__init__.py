"""Sources: a replayable generator of partitioned messages, and benchmark files."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


class MessageSource(DataSource):
    """Format ``tidemark``: ``partitions`` partitions in round robin, offsets from 0, deterministic keys; ``rows`` a read, ``limit`` in all.

    A position is a row number, so any range can be read again after a failure.
    """

    @classmethod
    def name(cls) -> str:
        return "tidemark"

    def schema(self) -> str:
        return "partition int, offset long, key string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Reader(self.options)


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, options) -> None:
        self.partitions, self.rows, self.limit = int(options.get("partitions", 100)), int(options.get("rows", 1000)), int(options.get("limit", 1 << 62))

    def initialOffset(self) -> dict:
        return {"at": 0}

    def rows_of(self, a: int, b: int) -> Iterator[tuple]:
        places = ((n % self.partitions, n // self.partitions) for n in range(a, b))
        return iter([(p, o, f"{p:02d}-{(p * 1_000_003 + o) % (1 << 64):016x}") for p, o in places])  # a batch is copied, so it's a list

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = min(self.limit, start["at"] + self.rows)
        return self.rows_of(start["at"], end), {"at": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self.rows_of(start["at"], end["at"])


def benchmark_runs(spark: SparkSession, path: str) -> DataFrame:
    """One row a run of a JSON file {defaults: {...}, runs: [{...}]}, each setting from the run or else the defaults."""
    doc = spark.read.json(path, multiLine=True)
    names = list(dict.fromkeys([f.name for f in doc.schema["defaults"].dataType.fields] + [f.name for f in doc.schema["runs"].dataType.elementType.fields]))
    runs = doc.select("defaults", F.posexplode("runs").alias("run_number", "run"))
    has = lambda kind, c: c in [f.name for f in runs.schema[kind].dataType.fields]
    return runs.select("run_number", *[F.coalesce(*[F.col(f"{k}.{c}") for k in ("run", "defaults") if has(k, c)]).alias(c) for c in names])


def benchmark_results(spark: SparkSession, path: str) -> DataFrame:
    schema = "timestamp string, message_count long, concurrent_keys int, processor_latency_ms int, jitter double, num_partitions int, duration_ms long, actual_tps double, theoretical_tps double, efficiency_pct double"
    return spark.read.csv(path, header=True, schema=schema)


def append_results(results: DataFrame, path: str) -> None:
    """Appends to a folder of CSV files, each with a header."""
    results.write.mode("append").csv(path, header=True)
