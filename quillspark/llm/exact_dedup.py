"""Exact duplicates with a heavy-hitter split. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, free, staged, table

#: A digest is heavy from this share of the rows on; at most 1 / HEAVY_SHARE digests are.
HEAVY_SHARE = 1 / 1024


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One small row per document; ``_row`` tells rows of equal id apart once staged."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).cast("binary"), 256).alias("text_sha256"),
        F.monotonically_increasing_id().alias("_row"),
    )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """Groups of equal texts: ``doc_id, keep_id, group_size, kept, text_sha256, _row``, a row per input row.

    Texts are equal when they are identical after lower-casing A-Z; null counts as empty.
    The row with the largest id of a group stays (a null id is below all others). Of rows
    that share both text and id only one has ``kept``. An empty table gives no rows; further
    columns of the input are not looked at.

    Misra-Gries counters (``freqItems``) over the digests name every digest above
    ``heavy_share``, perhaps with others; a second pass counts just those exactly. The
    verified winners, at most ``1 / heavy_share`` rows, are broadcast and settle their
    copies map-side. Only the remaining digests are shuffled, and none of those has more
    than that share of the rows; their groups are combined map-side and joined back.
    """
    small = staged(digests(docs, id_col, text_col), "digests")
    total = small.count()
    named = small.stat.freqItems(["text_sha256"], max(heavy_share, 1e-4)).first()[0] if total else []
    by = F.struct("doc_id", "_row")
    winners = (
        small.where(F.col("text_sha256").isin(list(named)))
        .groupBy("text_sha256")
        .agg(F.max(by).alias("_keep"), F.count(F.lit(1)).alias("group_size"))
        .where(F.col("group_size") > max(1, int(total * heavy_share)))
    )
    winners = staged(winners, "heavy")
    n_heavy = winners.count()
    assert n_heavy <= 1 / heavy_share + 1, n_heavy
    heavy = small.join(F.broadcast(winners), "text_sha256")
    rest = small.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
    # sums are combined before the shuffle, so a digest just below the share is no group in a task
    groups = rest.groupBy("text_sha256").agg(F.max(by).alias("_keep"), F.count(F.lit(1)).alias("group_size"))
    light = rest.join(groups, "text_sha256")
    return heavy.unionByName(light).select(
        "doc_id",
        F.col("_keep.doc_id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("_keep._row") == F.col("_row")).alias("kept"),
        "text_sha256",
        "_row",
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the copies, all columns as they were.

    The copies to drop are named by (id, digest) with the number of rows to keep being one,
    so rows of equal id and text lose all but one as well.
    """
    found = exact_duplicates(docs, id_col, text_col)
    sha, key = free(docs, "sha"), free(docs, "key")
    keep = found.where("kept").select(F.col("doc_id").alias(key), F.col("text_sha256").alias(free(docs, "kept_sha")))
    again = not found.groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    out = docs.withColumn(sha, F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).cast("binary"), 256))
    out = out.join(keep, F.col(id_col).eqNullSafe(F.col(key)) & (F.col(sha) == F.col(keep.columns[1])), "left_semi")
    if again:
        out = out.withColumn(key, F.col(id_col)).dropDuplicates([key, sha]).drop(key)
    return out.drop(sha)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents")).drop("_row")


OP7_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM d
"""
