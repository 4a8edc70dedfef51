"""Mixed-language texts as relational algebra over spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..shipping import spread
from .detect import STORE, in_rows, texts_only


def boundaries(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, text, cuts``: sorted positions where a span may begin or end."""
    at = spread(docs.select(F.col(id_col), F.col(text_col).alias("text")))
    cuts = F.concat(F.array(F.lit(0), F.length("text")).cast("array<bigint>"), tx.clause_ends(F.col("text")), tx.script_changes(F.col("text")))
    return at.select(id_col, "text", F.sort_array(F.array_distinct(cuts)).cast("array<int>").alias("cuts"))


def mixed_spans(docs: DataFrame, id_col: str, text_col: str = "text", path: str = STORE) -> DataFrame:
    """``id, start, end, text`` and the columns of a detection: the ordered spans of every text.

    Detect each piece; let pieces without a script join the one before (leading ones the
    first with a script); join neighbours of equal script and language; detect each span
    on its whole text. Windows are over the pieces of one text, an empty text has no span.
    """
    texts_only(docs, text_col)
    cut = boundaries(docs, id_col, text_col)
    pieces = cut.select(id_col, "text", "cuts", F.posexplode("cuts").alias("i", "start")).where(F.col("i") < F.size("cuts") - 1)
    pieces = pieces.select(id_col, "start", F.get("cuts", F.col("i") + 1).alias("end"), F.substring("text", F.col("start") + 1, F.get("cuts", F.col("i") + 1) - F.col("start")).alias("piece"))
    found = in_rows(pieces, F.col("piece"), "d", path).select(id_col, "start", "end", "piece", "d", F.when(F.col("d.script").isNotNull(), F.struct("d.script", "d.language_code")).alias("mark"))
    order = Window.partitionBy(id_col).orderBy("start")
    back, ahead = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    filled = found.withColumn("mark", F.coalesce(F.last("mark", True).over(back), F.first("mark", True).over(ahead)))
    before = F.lag("mark").over(order)
    island = filled.withColumn("new", (F.row_number().over(order) > 1) & ~F.col("mark").eqNullSafe(before)).withColumn("island", F.sum(F.col("new").cast("int")).over(back))
    parts = F.array_sort(F.collect_list(F.struct("start", "piece")))
    joined = island.groupBy(id_col, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), parts.alias("parts"), F.first("d").alias("one"))
    texts = joined.select(id_col, "start", "end", F.array_join(F.transform("parts", lambda p: p["piece"]), "").alias("text"), F.when(F.size("parts") == 1, F.col("one")).alias("one"))
    # a span of one piece has its detection already
    again = in_rows(texts, F.when(F.col("one").isNull(), F.col("text")), "more", path)
    return again.select(id_col, "start", "end", "text", F.coalesce("one", "more").alias("d")).select(id_col, "start", "end", "text", "d.*")


def mixed_summary(spans: DataFrame, id_col: str) -> DataFrame:
    """``id, segments, scripts, language_codes`` and the flags, for texts with spans."""
    ordered = F.array_sort(F.collect_list(F.struct("start", "end", "text", "script", "language_code", "confidence", "alternatives", "resolution", "label")))
    rows = spans.groupBy(id_col).agg(ordered.alias("segments"))
    unique = lambda k: F.array_distinct(F.array_compact(F.transform("segments", lambda s: s[k])))
    rows = rows.withColumns({"scripts": unique("script"), "language_codes": unique("language_code")})
    return rows.withColumns(
        {
            "is_mixed_script": F.size("scripts") > 1,
            "is_mixed_language": F.size("language_codes") > 1,
            "is_mixed": (F.size("scripts") > 1) | (F.size("language_codes") > 1),
            "has_unresolved_segments": F.exists("segments", lambda s: s["language_code"].isNull()),
        }
    )


def with_mixed_summary(docs: DataFrame, id_col: str, text_col: str = "text", path: str = STORE) -> DataFrame:
    """``id``, ``primary`` (the detection of the whole text) and ``mixed_summary`` of every text, by span algebra; an empty or null text has no spans.

    The span of a text that has one is the whole text, and has its detection already.
    """
    spans = mixed_summary(mixed_spans(docs, id_col, text_col, path), id_col)
    out = docs.select(F.col(id_col), F.col(text_col).alias("_whole")).join(spans, id_col, "left")
    same = F.get("segments", F.lit(0))
    one = F.coalesce((F.size("segments") == 1) & (same["text"] == F.col("_whole")), F.lit(False))
    out = in_rows(out, F.when(~one, F.col("_whole")), "primary", path)
    fields = [f.name for f in out.schema["primary"].dataType.fields]
    out = out.withColumn("primary", F.when(one, F.struct(*(same[k].alias(k) for k in fields))).otherwise(F.col("primary"))).drop("_whole")
    out = out.select(id_col, "primary", *(c for c in out.columns if c not in (id_col, "primary")))
    none = {"segments": F.array().cast(spans.schema["segments"].dataType), "scripts": F.array().cast("array<string>"), "language_codes": F.array().cast("array<string>")}
    flags = ("is_mixed_script", "is_mixed_language", "is_mixed", "has_unresolved_segments")
    return out.withColumns({**{c: F.coalesce(c, v) for c, v in none.items()}, **{c: F.coalesce(c, F.lit(False)) for c in flags}})
