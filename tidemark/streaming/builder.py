"""A consumer put together: source, envelope, lanes, user functions, sinks, limits and lifecycle."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.operators import envelope, outcomes, sequence
from tidemark.streaming import lifecycle

Sink = Callable[[DataFrame, int], None]


def traits():
    return (F.when(F.col("status") == "ok", 0).otherwise(outcomes.ERROR) + F.when(F.col("status") == "dead_letter", outcomes.DEAD_LETTER).otherwise(0)).cast("long")


class ConsumerBuilder:
    """Each option returns the builder; ``build`` gives a Consumer."""

    def __init__(self, topic: str, process: Callable[[dict], object], dead_letter: Callable[[dict, str], object]) -> None:
        if not topic or not topic.strip() or process is None or dead_letter is None:
            raise ValueError("topic, process and dead_letter are needed")
        self.topic, self._process, self._dead_letter = topic, process, dead_letter
        self._config, self._log, self._labels = Config(), logging.getLogger("tidemark"), {"topic": topic}
        self._extract = lambda df: envelope.extract(df, "partition", "offset", "key")
        self._context: dict = {}
        self._sinks: dict[str, Sink] = {}
        self._shutdown = None
        self._checkpoint = None
        self._last: dict[int, int] = {}  # the last offset of each assigned partition

    def config(self, config: Config) -> ConsumerBuilder:
        self._config = config
        return self

    def logger(self, log: logging.Logger) -> ConsumerBuilder:
        self._log = log
        return self

    def envelope(self, extract: Callable[[DataFrame], DataFrame]) -> ConsumerBuilder:
        self._extract = extract
        return self

    def enrich(self, **context) -> ConsumerBuilder:
        self._context |= context
        return self

    def service(self, name: str, team: str = "", consumer_group: str = "") -> ConsumerBuilder:
        self._labels |= {"service": name, "team": team, "consumer_group": consumer_group}
        return self

    def commit_sink(self, sink: Sink) -> ConsumerBuilder:
        self._sinks["commit"] = sink
        return self

    def metrics_sink(self, sink: Sink) -> ConsumerBuilder:
        """Its failures are logged; they never hold a commit."""
        self._sinks["metrics"] = sink
        return self

    def bandwidth_sink(self, sink: Sink) -> ConsumerBuilder:
        """Received messages by partition and batch, with the service's labels."""
        self._sinks["bandwidth"] = sink
        return self

    def shutdown_callback(self, callback: Callable[[str | None], None]) -> ConsumerBuilder:
        self._shutdown = callback
        return self

    def checkpoint(self, path: str) -> ConsumerBuilder:
        self._checkpoint = path
        return self

    def reset(self, *partitions: int) -> None:
        """Forgets the last offsets of these partitions, or of all: a new assignment may start anywhere."""
        for p in partitions or list(self._last):
            self._last.pop(p, None)

    def _validated(self, found: DataFrame) -> dict[int, int]:
        """The last offset of each partition after this batch, which goes in order of offsets: a repeated or negative one, or one that isn't beyond the last batch's, halts."""
        ranges = found.groupBy("partition").agg(F.min("offset").alias("low"), F.max("offset").alias("high"), F.count("*").alias("n"), F.count_distinct("offset").alias("each"))
        last = dict(self._last)
        for r in ranges.collect():  # one row a partition
            seen = last.get(r.partition)
            wrong = "negative" if r.low < 0 else "duplicate" if r.n > r.each or seen == r.low else "regression" if seen is not None and r.low < seen else None
            if wrong:
                raise outcomes.Halted(f"{wrong} offset: partition {r.partition} at {r.low}, after {seen}")
            last[r.partition] = r.high
        return last

    def batch(self, rows: DataFrame, number: int) -> None:
        """One micro-batch: foreign topics and offsets out of order halt it, dead letters are written while processing, then commits, then the sinks that may fail.

        Rows are committed only if all of the batch is processed, so its highest offsets are its contiguous watermarks.
        """
        if "topic" in rows.columns:
            rows = envelope.guard(rows, self.topic)
        found = envelope.stamped(self._extract(rows))
        last = self._validated(found)
        if self._context:
            found = envelope.enrich(found, **self._context)
        done = outcomes.apply(sequence.lanes(found), self._process, self._dead_letter).withColumn("traits", traits()).persist()
        try:
            halt = done.where("status = 'halt'").agg(F.min(F.struct("partition", "offset", "error")).alias("h")).first().h
            if halt is not None:
                raise outcomes.Halted(f"partition {halt.partition} at {halt.offset}: {halt.error}")
            if "commit" in self._sinks:
                self._sinks["commit"](done.groupBy("partition").agg(F.max("offset").alias("offset")), number)
            self._last = last
            self._try("metrics", lambda: envelope.metrics(done), number)
            labels = {k: F.lit(v) for k, v in self._labels.items()}
            self._try("bandwidth", lambda: done.groupBy("partition").agg(F.count("*").alias("received_messages")).withColumns(labels), number)
        finally:
            done.unpersist()

    def _try(self, name: str, rows: Callable[[], DataFrame], number: int) -> None:
        if name in self._sinks:
            try:
                self._sinks[name](rows(), number)
            except Exception as e:
                self._log.error("%s sink: %s", name, e)

    def build(self, stream: DataFrame, **trigger) -> lifecycle.Consumer:
        """trigger: of writeStream, by default the commit interval.  A rate limit is an option of the source (rows or offsets a trigger)."""
        trigger = trigger or {"processingTime": self._config.trigger()}

        def start():
            self.reset()
            writer = stream.writeStream.foreachBatch(self.batch).queryName(self.topic)
            if self._checkpoint:
                writer = writer.option("checkpointLocation", self._checkpoint)
            return writer.trigger(**trigger).start()

        return lifecycle.Consumer(start, self._config, self._shutdown)
