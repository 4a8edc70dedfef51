"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free, staged, table

#: White space of a token count: space and U+0009 to U+000D.
TOKEN = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
#: Rows that one task ranks at most, on average, within a class of equal size.
RANK_ROWS = 4096


def targets(sizes: dict, weights=WEIGHTS, cap: float = CAP) -> dict:
    """Target size of each source: shares by weight, none above ``cap`` times its size.

    ``sizes`` maps a source to its size, in order (code point order, null last); the
    weights repeat along it. What a source cannot take is shared again by weight among the
    others until none is above its limit. If all are at their limit, the rest goes nowhere.
    """
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sizes)}
    left, open_, out = float(sum(sizes.values())), dict(weight), {}
    while open_:
        whole = math.fsum(open_.values())
        over = [s for s in open_ if left * open_[s] / whole > cap * sizes[s]]
        if not over:
            out |= {s: left * w / whole for s, w in open_.items()}
            break
        for s in over:
            out[s] = cap * sizes[s]
            open_.pop(s)
        left -= math.fsum(out[s] for s in over)
    return out


def rate(x, lam, cap: float = CAP):
    """Exponentially tilted rate of a document of (scaled) size ``x``, at most ``cap``."""
    return np.minimum(cap, np.exp(np.minimum(x * lam, 50.0)))


def solve_dual(hist: DataFrame, state: list[dict], cap: float = CAP, rounds: int = 200, tolerance: float = 1e-9) -> dict:
    """Newton's method on the convex dual, a multiplier for each source's token constraint.

    Minimising the relative entropy of the rates to one under "sum of size x rate = target"
    and "rate <= cap" gives rate = min(cap, exp(lambda x size)). Each iteration is one
    distributed aggregation (gradient and curvature for all sources at once) over the
    histogram of sizes; the driver holds the dual vector, a number for each source. A bracket
    guards the steps; it is widened twofold until it holds the root. A constraint that is not met
    to ``tolerance`` after ``rounds`` is an error.
    """
    spark = hist.sparkSession
    lam = {s["k"]: 0.0 for s in state}
    low, high = dict.fromkeys(lam, -math.inf), dict.fromkeys(lam, math.inf)
    goal = {s["k"]: s["target"] / s["scale"] for s in state if s["scale"] > 0}
    live = set(goal)  # a source without a word has no constraint: its documents add nothing at any rate
    for s in state:  # all at the limit: no finite multiplier
        if s["scale"] > 0 and s["target"] >= s["size"] * cap * (1 - 1e-12):
            lam[s["k"]] = 1e6
            live.discard(s["k"])
        if s["scale"] > 0 and s["target"] <= 0:
            lam[s["k"]] = -1e6
            live.discard(s["k"])
    hist = hist.select("k", "x", "n")
    for _ in range(rounds):
        if not live:
            break
        now = spark.createDataFrame([(k, lam[k]) for k in sorted(live)], "k int, lam double")
        tilt = F.exp(F.least(F.col("x") * F.col("lam"), F.lit(50.0)))
        sums = (
            hist.join(now, "k")
            .withColumn("r", F.least(F.lit(cap), tilt))
            .groupBy("k")
            .agg(F.sum(F.col("n") * F.col("x") * F.col("r")).alias("g"), F.sum(F.when(F.col("r") < cap, F.col("n") * F.col("x") * F.col("x") * F.col("r")).otherwise(0.0)).alias("h"))
        )
        for k, g, h in sums.collect():  # a row for each constraint
            miss = g - goal[k]
            if abs(miss) <= tolerance * goal[k]:
                live.discard(k)
                continue
            (high if miss > 0 else low)[k] = lam[k]
            lam[k] = next_multiplier(lam[k], miss, h, low[k], high[k])
    if live:
        raise RuntimeError(f"no multiplier within {tolerance} of the target after {rounds} rounds for sources {sorted(live)}")
    return lam


def next_multiplier(now: float, miss: float, curvature: float, low: float, high: float) -> float:
    """The Newton step if the bracket holds it; else its middle, or twice as far where it has no end."""
    wide = high - low == math.inf
    reach = max(1.0, 2 * abs(now)) if wide else 0.0
    step = now - miss / curvature if curvature > 0 else math.inf
    if low < step < high and (not wide or abs(step - now) <= 8 * reach):
        return step
    if not wide:
        return (low + high) / 2
    return now - reach if miss > 0 else now + reach


def _copies(pdf: pd.DataFrame) -> pd.DataFrame:
    """Whole copies for the size classes of one source, largest first, the rest carried on."""
    pdf = pdf.sort_values("size", ascending=False)
    want = taken = 0.0
    out = []
    for size, n, r in zip(pdf["size"], pdf["n"], pdf["rate"], strict=True):
        want += size * n * r
        least, most = n * math.floor(r), n * math.ceil(r)
        total = int(min(max(round((want - taken) / size) if size else n, least), most))
        taken += total * size
        out.append(total)
    return pdf.assign(copies=out)[["k", "size", "copies", "rate"]]


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """Copies of every document: ``doc_id, source, size, source_size, target, rate, copies, taken``.

    Size is the number of runs of non-white-space (null text: 0). All rows count, repeated
    ones too; null sources are one source, the last. Documents of size 0 have rate 1 and
    add nothing; a source of such documents alone has target 0. Targets and limits are those of ``targets``. Rounding keeps the sum of a source
    near its target: size classes are served from the largest on, each getting between
    floor and ceiling of its rate, with the error carried on; inside a class the documents of
    least hash get the extra copy, so reruns agree. An empty table gives no rows.

    A hot source is no group anywhere: sums are combined before the shuffle, the copies of a source
    are set on its histogram of sizes, and ranks are taken in hash buckets of bounded size. The driver
    holds a row for each source: sources are the constraints of the dual.
    """
    return _mixed(docs, id_col, text_col, source_col, weights, cap).drop("_row")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """``docs``, all its columns, with what ``mix`` says of each row: ``size, source_size, target, rate, copies, taken``.

    Columns of ``docs`` with such a name give way to them. ``repeated_documents`` writes the copies out.
    """
    row = free(docs, "row")
    kept = staged(docs.withColumn(row, F.monotonically_increasing_id()), "mixed")
    figures = ["size", "source_size", "target", "rate", "copies", "taken"]
    found = _mixed(kept, id_col, text_col, source_col, weights, cap, row).select(F.col("_row").alias(row), *figures)
    lower = {c.lower() for c in figures}
    return kept.drop(*(c for c in docs.columns if c.lower() in lower)).join(found, row).drop(row)


def repeated_documents(mixed: DataFrame) -> DataFrame:
    """The training set itself: every row of ``mixed_documents`` as often as it has copies."""
    nth = free(mixed, "copy")
    return mixed.where("copies > 0").withColumn(nth, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop(nth)


def _mixed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights, cap: float, row_col: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(TOKEN)).cast("long")
    rows = staged(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), F.xxhash64(F.col(id_col).cast("string")).alias("_h"), (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("_row")),
        "sizes",
    )
    hist = staged(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "histogram")
    per = [(r[0], int(r[1] or 0), int(r[2])) for r in hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")), F.sum("n")).collect()]
    per.sort(key=lambda r: (r[0] is None, r[0] or ""))
    goal = targets({r[0]: r[1] for r in per}, weights, cap)
    state = [{"k": k, "source": s, "size": n, "target": goal[s], "scale": n / max(1, rows_)} for k, (s, n, rows_) in enumerate(per)]
    dims = spark.createDataFrame([(x["k"], x["source"], x["size"], float(x["target"]), float(x["scale"])) for x in state], "k int, source string, source_size long, target double, scale double")
    keyed = staged(
        hist.join(dims, hist["source"].eqNullSafe(dims["source"])).select("k", "size", "n", F.when(F.col("scale") > 0, F.col("size") / F.col("scale")).otherwise(0.0).alias("x")),
        "classes",
    )
    lam = solve_dual(keyed, state, cap)
    dual = spark.createDataFrame([(k, float(v)) for k, v in lam.items()], "k int, lam double")
    tilted = keyed.join(dual, "k").select("k", "size", "n", F.when(F.col("size") == 0, 1.0).otherwise(F.least(F.lit(float(cap)), F.exp(F.least(F.col("x") * F.col("lam"), F.lit(50.0))))).alias("rate"))
    copies = staged(tilted.groupBy("k").applyInPandas(_copies, "k int, size long, copies long, rate double"), "copies")

    # ranks by hash inside a class, in buckets that follow the hash's order
    classes = copies.join(keyed.select("k", "size", "n"), ["k", "size"]).select(
        "k", "size", "rate", "n", F.floor("rate").cast("long").alias("base"), (F.col("copies") - F.col("n") * F.floor("rate")).cast("long").alias("extra")
    )
    placed = rows.join(dims, rows["source"].eqNullSafe(dims["source"])).drop(dims["source"]).join(classes, ["k", "size"])
    width = F.ceil(F.col("n") / RANK_ROWS)
    placed = placed.withColumn("_b", F.floor((F.shiftrightunsigned("_h", 33) * width) / F.lit(2.0**31)).cast("long"))
    # dealt out by bucket, so that a class of very many documents is spread over tasks
    placed = placed.repartition("k", "size", "_b")
    per_bucket = placed.groupBy("k", "size", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("k", "size").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    per_bucket = per_bucket.select("k", "size", "_b", F.coalesce(before, F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("k", "size", "_b").orderBy(F.shiftrightunsigned("_h", 33), "_h", "doc_id", "_row"))
    return (
        placed.join(per_bucket, ["k", "size", "_b"])
        .withColumn("copies", F.col("base") + F.when(F.col("_before") + rank <= F.col("extra"), 1).otherwise(0))
        .select("doc_id", "source", F.col("size").cast("long").alias("size"), F.col("source_size"), "target", "rate", F.col("copies").cast("long").alias("copies"), (F.col("copies") * F.col("size")).cast("long").alias("taken"), "_row")
    )


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")
