"""Helpers shared by the corpus operators: tables, durable intermediate tables, components."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.shipping import ensure_shipped

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Bits in a piece of a bitmap, which is what ``bitmap_construct_agg`` makes; bits for each key, and bits at most.
PIECE, KEY_BITS, MAX_BITS = 8 * 4096, 16, 1 << 28


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    ensure_shipped(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor and the driver can reach.

    It is the one that ``spark.checkpoint.dir`` names. Only a local session without that
    setting gets a temporary folder, since there one machine holds everything.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillspark-"))
    return sc.getCheckpointDir().rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read back.

    This cuts the lineage: a lost executor costs a reread of the table, not a rerun of what
    made it, and ids given before the write stay what they were. The shuffle files of the
    query are let go once the table stands.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillspark-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    del df
    gc.collect()
    return spark.read.schema(schema).parquet(path)


def free(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` has no column of."""
    taken = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name.lower() in taken:
        name += "_"
    return name


def marked(rows: DataFrame, keys: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` with the boolean ``name``: whether ``key``, a hash, may be in the column ``key`` of ``keys``.

    It is true for every row whose key is there, and for one in ``KEY_BITS`` of the others, so an exact join of those marked
    has to follow, which then shuffles what it needs and not the whole table. A bit stands for each key: two bytes a key are
    broadcast, and 32 MB at most, where more rows are marked if there are more keys.
    """
    size = min(MAX_BITS, KEY_BITS * keys.count())
    pieces = max(1, -(-size // PIECE))
    at = F.pmod(F.col(key), F.lit(pieces * PIECE).cast("long"))
    piece, bit = F.shiftright(at, 15), at.bitwiseAND(F.lit(PIECE - 1)).cast("int")
    names = [free(rows, "piece"), free(rows, "bits")]
    bits = keys.where(F.col(key).isNotNull()).select(piece.alias(names[0]), bit.cast("long").alias("at")).repartition(names[0])
    bits = bits.groupBy(names[0]).agg(F.bitmap_construct_agg("at").alias(names[1]))
    byte = F.conv(F.hex(F.substring(F.col(names[1]), F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn(names[0], piece).join(F.broadcast(bits), names[0], "left")
    return found.withColumn(name, F.coalesce(F.getbit(byte, bit.bitwiseAND(F.lit(7))) == 1, F.lit(False))).drop(*names)


def likely(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` without most of those whose ``key`` is not in the column ``key`` of ``keys``: those that are ``marked``."""
    name = free(rows, "mark")
    return marked(rows, keys, key, name).where(name).drop(name)


def ascii_lower(text):
    """Lower-case A-Z alone. ``lower`` does just that for ASCII and is far cheaper there."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph: rows (node, root), root the least node.

    Alternating large-star and small-star steps; each is a minimum by node (combined before
    the shuffle) joined back to the edges, so a hub with a great many neighbours is no group
    in any task's memory. Every round is staged. Nodes without edges give no row.
    """
    spark = edges.sparkSession
    now = staged(
        edges.where((F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "edges",
    )
    mark = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
            .select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        now = staged(small, "edges")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u")).first()
        if seen == mark or seen[0] == seen[2] and now.join(now.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select("v").distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select(F.col("v").alias("node"), F.col("v").alias("root"))
    )
