"""Change batches applied epoch by epoch, with Structured Streaming.

Each micro-batch is one commit: late entries (of an epoch that is readable already) are counted from the next epoch on
rather than dropped, with the epoch they came with beside it; entries are written under the batch's id, replacing what
an earlier try wrote, and the newest epoch becomes readable with the batch's marker, or, where epochs go on over several
batches (``hold``), once a later epoch was seen or the input has ended. Readers see whole batches only.

Where entries come over several channels, the read epoch is the least over the channels of the newest epoch that each
has sent: what a channel sends ahead of the others is kept, and out of readers' view until the slowest has caught up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlake.operators.snapshots import clamp_late

MARKER = "batch long, read_epoch long, newest timestamp_ntz, entries long, tops map<string, long>"
OWN = "own_epoch"  # the epoch of an entry before it was moved


class EpochPipeline:
    """A change log under ``path``: ``log/batch=N`` and, once it is whole, ``marks/batch=N``.

    The newest ``hold`` epochs of a batch aren't readable yet, until a later batch or ``finish`` makes them so.
    ``channels`` are the values of the column ``channel`` (few, and known from the start); a channel that has sent
    nothing yet holds everything back. Without them the whole stream is one channel.
    """

    def __init__(self, spark: SparkSession, path: str, *, ts: str = "ts", hold: int = 0, channels: tuple[str, ...] = ()):
        self.spark, self.path, self.ts, self.hold, self.channels = spark, path, ts, hold, channels

    def marks(self) -> DataFrame:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/marks")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], MARKER)
        return self.spark.read.schema(MARKER).option("recursiveFileLookup", True).parquet(f"{self.path}/marks")

    def read_epoch(self, before: int | None = None) -> int:
        """The newest epoch that readers may see (-1: none), of batches before this one."""
        marks = self.marks()
        found = (marks if before is None else marks.where(F.col("batch") < before)).agg(F.max("read_epoch")).first()[0]
        return -1 if found is None else found

    def commit(self, batch: DataFrame, batch_id: int) -> None:
        """Apply one batch; doing it again has the same result."""
        known = self.read_epoch(batch_id)
        entries = clamp_late(batch.withColumn(OWN, F.col("epoch")), known + 1)
        at = f"{self.path}/log/batch={batch_id}"
        entries.write.mode("overwrite").parquet(at)
        written = self.spark.read.schema(entries.schema).parquet(at)
        channel = F.col("channel").cast("string") if self.channels else F.lit("")
        tops = self._tops(batch_id)
        for r in written.groupBy(channel.alias("channel")).agg(F.max("epoch").alias("top")).where("channel is not null").collect():  # one row a channel
            tops[r["channel"]] = max(tops.get(r["channel"], -1), r["top"])
        read = max(known, min(tops.get(x, -1) for x in self.channels or ("",)) - self.hold)
        told = F.create_map(*(F.lit(x) for kv in tops.items() for x in kv)).cast("map<string, long>")
        mark = written.agg(F.lit(batch_id).cast("long").alias("batch"), F.lit(read).cast("long").alias("read_epoch"), F.max(self.ts).alias("newest"), F.count("*").alias("entries"), told.alias("tops"))
        mark.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/marks/batch={batch_id}")

    def _tops(self, before: int) -> dict[str, int]:
        """The newest epoch of each channel in batches before this one."""
        last = self.marks().where((F.col("batch") < before) & F.col("tops").isNotNull()).agg(F.max_by("tops", "batch")).first()[0]
        return dict(last or {})

    def finish(self) -> None:
        """Make every epoch readable, after the end of the input; doing it again has the same result."""
        last = self.marks().agg(F.max("batch")).first()[0]
        if last is not None:
            every = self.spark.read.schema("epoch long, batch long").option("basePath", f"{self.path}/log").parquet(f"{self.path}/log").where(F.col("batch") <= last)
            end = every.agg(F.lit(last).cast("long").alias("batch"), F.greatest(F.max("epoch"), F.lit(self.read_epoch())).alias("read_epoch"), F.lit(None).cast("timestamp_ntz").alias("newest"), F.lit(0).cast("long").alias("entries"), F.lit(None).cast("map<string, long>").alias("tops"))
            end.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/marks/end={last}")

    def start(self, stream: DataFrame, **trigger) -> StreamingQuery:
        """Follow a stream of entries that have the column ``epoch``; by default until what is there has been read."""
        out = stream.writeStream.foreachBatch(self.commit).option("checkpointLocation", f"{self.path}/checkpoint")
        return out.trigger(**(trigger or {"availableNow": True})).start()

    def log(self, schema: str) -> DataFrame:
        """All entries of committed batches."""
        every = self.spark.read.schema(f"{schema}, batch long").option("basePath", f"{self.path}/log").parquet(f"{self.path}/log")
        return every.join(self.marks().select("batch"), "batch", "left_semi").drop("batch")

    def staleness(self, schema: str) -> DataFrame:
        """Seconds from the newest entry that readers may see until now (null: they see none)."""
        seen = F.max(F.col(self.ts).cast("timestamp"))
        return self.readable(schema).agg((F.unix_micros(F.current_timestamp()) - F.unix_micros(seen)).alias("us")).select((F.col("us") / 1e6).alias("stale_s"))

    def readable(self, schema: str) -> DataFrame:
        """The entries that readers may see: of committed batches, and not ahead of the read epoch."""
        return self.log(schema).where(F.col("epoch") <= self.read_epoch())


def report(query: StreamingQuery) -> dict[str, float]:
    """What a stream did in its last batches (as many as Spark keeps): batches, entries, seconds, entries a second."""
    done = [p for p in query.recentProgress if p.numInputRows]
    entries, seconds = sum(p.numInputRows for p in done), sum(p.durationMs.get("triggerExecution", 0) for p in done) / 1000
    return {"batches": len(done), "entries": entries, "seconds": seconds, "per_second": entries / seconds if seconds else 0.0}


def freshness(log: DataFrame, epoch_seconds: int, *, ts: str = "ts") -> DataFrame:
    """How far each epoch's end is past its newest entry, in seconds: most, least, mean and median over the epochs."""
    newest = log.groupBy("epoch").agg(F.max(F.unix_micros(F.col(ts).cast("timestamp"))).alias("us"))
    lag = newest.select(((F.col("epoch") + 1) * epoch_seconds - F.col("us") / 1e6).alias("lag"))
    return lag.agg(*(F.round(x, 3).alias(n) for n, x in (("most", F.max("lag")), ("least", F.min("lag")), ("mean", F.avg("lag")), ("median", F.percentile("lag", F.lit(0.5))))), F.count("*").alias("epochs"))
