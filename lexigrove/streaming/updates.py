"""A collection that follows a stream of change events.

Events (ts, event, path, path2, text) are WRITE, CREATE, APPEND, TRUNCATE, RENAME and UNLINK. Each micro-batch becomes
one generation: a folder named by the batch's number, so a batch that is run again replaces itself. The current
collection is the latest state of each path over the newest base and the generations after it; readers that hold an
older base keep a consistent view. Compaction writes a new base without what is gone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

SCHEMA = "ts timestamp, seq long, event string, path string, path2 string, text string"
STATE = "path string, at struct<ts: timestamp, seq: long>, gone boolean, text string"
#: How long events are held for later ones of the same path; share of dead rows that calls for compaction.
HOLD, GARBAGE = "1 second", 0.40


def held(events: DataFrame, hold: str = HOLD) -> DataFrame:
    """A stream of events without repeated deliveries that come within ``hold`` of each other; later ones than that are
    dropped, as the watermark has it. For sources that deliver more than once."""
    return events.withWatermark("ts", hold).dropDuplicatesWithinWatermark(["path", "event", "seq"])


def reduced(events: DataFrame) -> DataFrame:
    """Without events that a later one of the same path makes void: what comes before the last whole write, truncation
    or removal. A rename is a barrier: what precedes it in its path stays."""
    before = Window.partitionBy("path").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("path", "__g").orderBy(F.desc("ts"), F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    void = F.coalesce(F.max(F.col("event").isin("WRITE", "CREATE", "TRUNCATE", "UNLINK")).over(later), F.lit(False))
    grouped = events.withColumn("__g", F.coalesce(F.sum((F.col("event") == "RENAME").cast("int")).over(before), F.lit(0)))
    return grouped.withColumn("__v", void).where("not __v or event = 'RENAME'").drop("__g", "__v")


class LiveCollection:
    """The collection below ``root``, a folder that the cluster shares."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _folders(self, kind: str) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{kind}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [(s.getPath().getName(), s.getPath()) for s in fs.listStatus(path)]
        done = [n for n, p in names if n.isdigit() and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(map(int, done))

    def states(self, below: int | None = None) -> DataFrame:
        """All states since the newest base (before generation ``below``); a path may have several."""
        bases = [b for b in self._folders("base") if below is None or b < below]
        after = bases[-1] if bases else -1
        paths = [f"{self.root}/base/{after}"] * bool(bases) + [f"{self.root}/generation/{g}" for g in self._folders("generation") if g > after and (below is None or g < below)]
        return self.spark.read.schema(STATE).parquet(*paths) if paths else self.spark.createDataFrame([], STATE)

    def current(self, below: int | None = None) -> DataFrame:
        """path, text of what there is (before generation ``below``)."""
        last = self.states(below).groupBy("path").agg(F.max_by(F.struct("gone", "text"), "at").alias("x"))
        return last.where("not x.gone").select("path", "x.text")

    def apply(self, events: DataFrame, batch: int) -> None:
        """Writes the generation of one micro-batch. Events of a path take effect in the order of (ts, seq)."""
        events = reduced(events)
        moves = events.where("event = 'RENAME'")
        arrive = moves.select("ts", "seq", F.lit("ARRIVE").alias("event"), F.col("path2").alias("path"), F.col("path").alias("path2"), F.lit(None).cast("string").alias("text"))
        # What a moved path held: its last text before the move, from this batch or from before it.
        before = self.states(batch).join(moves.select("path").distinct(), "path", "left_semi").select(F.col("at.ts").alias("ts"), F.col("at.seq").alias("seq"), F.when(F.col("gone"), "UNLINK").otherwise("WRITE").alias("event"), "path", F.lit(None).cast("string").alias("path2"), "text")
        asof = Window.partitionBy("path").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, -1)
        known = events.select("ts", "seq", "event", "path", "path2", "text").unionByName(before).withColumn("was", F.last(F.when(F.col("event").isin("WRITE", "CREATE"), F.col("text")), ignorenulls=True).over(asof))
        carried = known.where("event = 'RENAME'").select(F.col("ts").alias("mts"), F.col("seq").alias("mseq"), "was")
        arrive = arrive.join(carried, (F.col("ts") == F.col("mts")) & (F.col("seq") == F.col("mseq")), "left").select("ts", "seq", F.lit("WRITE").alias("event"), "path", F.lit(None).cast("string").alias("path2"), F.col("was").alias("text"))
        olds = self.current(batch).join(events.where("event = 'APPEND'").select("path").distinct(), "path", "left_semi").select("path", F.col("text").alias("old"))
        every = events.select("ts", "seq", "event", "path", "path2", "text").unionByName(arrive)
        run = Window.partitionBy("path").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        # An append adds to the last whole write of the batch, or to what was there.
        whole = F.sum((F.col("event") != "APPEND").cast("int")).over(run)
        joined = every.withColumn("__w", whole).groupBy("path", "__w").agg(F.max(F.struct("ts", "seq")).alias("at"), F.array_sort(F.collect_list(F.struct("ts", "seq", "event", "text"))).alias("parts"))
        last = joined.groupBy("path").agg(F.max_by(F.struct("__w", "at", "parts"), "__w").alias("x")).select("path", "x.*").join(olds, "path", "left")
        first = F.col("parts")[0]["event"]
        text = F.array_join(F.transform("parts", lambda p: F.coalesce(p["text"], F.lit(""))), "")
        states = last.select("path", "at", first.isin("UNLINK", "RENAME").alias("gone"), F.when(first == "APPEND", F.concat(F.coalesce("old", F.lit("")), text)).when(first == "TRUNCATE", F.lit("")).otherwise(text).alias("text"))
        states.write.mode("overwrite").parquet(f"{self.root}/generation/{batch}")

    def follow(self, events: DataFrame, checkpoint: str) -> StreamingQuery:
        """Applies all events that are there; started again, it goes on where it stopped.

        States carry their event's time, so whole writes and removals that arrive late still take their place.
        """
        return events.writeStream.foreachBatch(lambda batch, number: self.apply(batch, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def garbage(self) -> float:
        """The share of rows that are superseded or gone."""
        row = self.states().groupBy("path").agg(F.count("*").alias("n"), F.max_by("gone", "at").alias("gone")).agg(F.sum("n").alias("all"), F.sum(F.when(F.col("gone"), 0).otherwise(1)).alias("live")).first()
        return 1 - (row["live"] or 0) / row["all"] if row["all"] else 0.0

    def compact(self, ratio: float = GARBAGE) -> bool:
        """Writes a new base if garbage has reached ``ratio``; older folders are left to readers that still use them."""
        generations = self._folders("generation")
        if not generations or self.garbage() < ratio:
            return False
        at = self.states().groupBy("path").agg(F.max("at").alias("at"), F.max_by(F.struct("gone", "text"), "at").alias("x"))
        at.where("not x.gone").select("path", "at", "x.gone", "x.text").write.mode("overwrite").parquet(f"{self.root}/base/{generations[-1]}")
        return True


def replayed(events: DataFrame) -> DataFrame:
    """path, text after all of ``events`` (WRITE, CREATE, TRUNCATE and UNLINK only) at once."""
    last = events.groupBy("path").agg(F.max_by(F.struct("event", "text"), F.struct("ts", "seq")).alias("x"))
    return last.where("x.event <> 'UNLINK'").select("path", F.when(F.col("x.event") == "TRUNCATE", "").otherwise(F.coalesce("x.text", F.lit(""))).alias("text"))


def from_events(events: DataFrame) -> DataFrame:
    """A change stream made of the events table: a path for each user, purchases remove it, clicks empty it."""
    kind = F.when(F.col("event_type") == "purchase", "UNLINK").when(F.col("event_type") == "click", "TRUNCATE").otherwise("WRITE")
    return events.select("ts", F.col("event_id").alias("seq"), kind.alias("event"), F.concat(F.lit("/u/"), F.col("user_id").cast("string")).alias("path"), F.lit(None).cast("string").alias("path2"), F.col("props").alias("text"))
