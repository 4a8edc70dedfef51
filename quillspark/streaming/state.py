"""Totals, breakdowns and profiles that stay current as texts arrive, and count no text twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from ..functions import text as tx
from ..operators import evaluate as ev
from ..operators import profiles as pf

#: Batches whose counts are added up into one table, so that the number of tables to read stays small.
EVERY = 32


class RunningCounts:
    """Counts by key of all batches of a stream, in a folder.

    A batch's counts are a table named by the batch's number, written over if the batch comes again, so a retry or a restart
    counts nothing twice. ``sums`` are added up, of ``mins`` the least counts. Now and then the tables so far are
    added up into one; it counts once a record of it stands in ``done``, so a failure in between loses nothing.
    """

    def __init__(self, folder: str, keys: list[str], sums: list[str], mins: list[str] | None = None, every: int = EVERY):
        self.folder, self.keys, self.sums, self.mins, self.every = folder.rstrip("/"), keys, sums, mins or [], every

    def combined(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(*(F.sum(c).alias(c) for c in self.sums), *(F.min(c).alias(c) for c in self.mins))

    def add(self, rows: DataFrame, batch: int) -> None:
        """The counts of one batch: rows with the keys, sums and mins."""
        self.combined(rows).write.mode("overwrite").parquet(f"{self.folder}/level=0/batch={batch}")
        if batch % self.every == self.every - 1:
            spark = rows.sparkSession
            self.current(spark, batch).write.mode("overwrite").parquet(f"{self.folder}/level=1/batch={batch}")
            spark.range(1).select(F.lit(batch).cast("long").alias("upto")).write.mode("overwrite").parquet(f"{self.folder}-done/batch={batch}")

    def _done(self, spark: SparkSession) -> int:
        try:
            return spark.read.parquet(f"{self.folder}-done").agg(F.max("upto")).first()[0]
        except AnalysisException:  # none yet
            return -1

    def current(self, spark: SparkSession, upto: int | None = None) -> DataFrame:
        """All counts so far, or those of the batches up to a number."""
        done = self._done(spark)
        level, batch = F.col("level"), F.col("batch")
        rows = spark.read.option("basePath", self.folder).parquet(f"{self.folder}/level=*")
        rows = rows.where(((level == 1) & (batch == done)) | ((level == 0) & (batch > done)))
        return self.combined(rows if upto is None else rows.where(batch <= upto))


def _started(stream: DataFrame, add, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class RunningEvaluation:
    """Totals and breakdown of an evaluation of cases that arrive."""

    MEASURES = ("cases", "exact", "script_only", "wrong", "attempted", "language_correct", "script_correct")

    def __init__(self, folder: str, detector=None, every: int = EVERY):
        columns = list(dict.fromkeys(c for s in ev.SETS for c in s))
        self.columns, self.detector = columns, detector
        self.counts = RunningCounts(folder, ["grouping", *columns], list(self.MEASURES), every=every)

    def add(self, cases: DataFrame, batch: int) -> None:
        rows = ev.evaluate(cases, self.detector)
        whole = ev.totals(rows).select(F.lit("").alias("grouping"), *(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in self.columns), *self.MEASURES)
        self.counts.add(ev.breakdown(rows).unionByName(whole), batch)

    def start(self, cases: DataFrame, checkpoint: str) -> StreamingQuery:
        """Evaluate all cases that are there now and not counted yet."""
        return _started(cases, self.add, checkpoint)

    def totals(self, spark: SparkSession) -> DataFrame:
        return ev.with_shares(self.counts.current(spark).where("grouping = ''").select(*self.MEASURES))

    def breakdown(self, spark: SparkSession) -> DataFrame:
        return self.counts.current(spark).where("grouping <> ''")


class RunningProfiles:
    """n-gram profiles of samples that arrive text by text: what training on all texts at once gives.

    ``order`` is the column that a key's texts are read in; their n-grams are all kept with their counts and first places, since any of
    them may come to the top.
    """

    def __init__(self, folder: str, keys: list[str], order: str, text: str = "text", size: int = pf.PROFILE_SIZE, every: int = EVERY):
        self.keys, self.order, self.text, self.size = keys, order, text, size
        self.counts = RunningCounts(folder, [*keys, "ngram"], ["cnt"], ["first"], every)

    def add(self, samples: DataFrame, batch: int) -> None:
        words = pf.word_counts(samples, self.keys, tx.tokens(tx.normalise(F.col(self.text))), self.order)
        self.counts.add(pf.ngram_counts(words, self.keys), batch)

    def start(self, samples: DataFrame, checkpoint: str) -> StreamingQuery:
        """Count all texts that are there now and not counted yet."""
        return _started(samples, self.add, checkpoint)

    def profiles(self, spark: SparkSession) -> DataFrame:
        """``keys, ngram, cnt, rank`` as ``profiles.build_profiles`` has them."""
        return pf.top_ngrams(self.counts.current(spark), self.keys, self.size).select(*self.keys, "ngram", "cnt", "rank")
