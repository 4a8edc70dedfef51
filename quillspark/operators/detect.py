"""Script and language of texts: as relational algebra, and as an Arrow function."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions import charsets
from ..functions import text as tx
from ..functions.rowlocal import TOP, Detector
from ..resources import fixed
from ..shipping import ensure_shipped, spread
from . import inrow
from .profiles import STORE, load_profiles, ngram_counts, profile_frames, top_ngrams, word_counts

DETECTION = "script string, language_code string, confidence double, alternatives array<struct<language_code: string, score: double>>, resolution string, label string"
SEGMENT = f"start int, end int, text string, {DETECTION}"
_NESTED = DETECTION.replace("script string", "script: string").replace("language_code string,", "language_code: string,").replace("confidence double", "confidence: double").replace("alternatives array", "alternatives: array").replace("resolution string", "resolution: string").replace("label string", "label: string")
MIXED = (
    f"primary struct<{_NESTED}>, segments array<struct<start: int, end: int, text: string, {_NESTED}>>, scripts array<string>, language_codes array<string>, "
    "is_mixed_script boolean, is_mixed_language boolean, is_mixed boolean, has_unresolved_segments boolean"
)


def texts_only(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs``, or an error before anything runs if the column holds no strings."""
    kind = docs.select(text_col).schema[0].dataType
    if not isinstance(kind, T.StringType):
        raise TypeError(f"column {text_col} must hold strings, not {kind.simpleString()}")
    return docs


# --- relational form -------------------------------------------------------------------------


def text_features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, norm, chars, script, n_script, script_share, words, n_words``; nulls stay null."""
    found = tx.with_dominant_script(spread(docs.select(F.col(id_col), F.col(text_col).alias("_text"))), "_text").drop("_text")
    found = found.withColumn("words", tx.tokens(F.col("norm")))
    return found.withColumn("n_words", F.size("words"))


def _languages(spark: SparkSession, path: str) -> DataFrame:
    """``script, language_code, language_order, languages``: candidates by script."""
    seen: dict[tuple, int] = {}
    for p in load_profiles(path):
        seen.setdefault((p["script"], p["language_code"]), p["order"])
    size: dict[str, int] = {}
    for script, _ in seen:
        size[script] = size.get(script, 0) + 1
    return spark.createDataFrame([(s, k, o, size[s]) for (s, k), o in seen.items()], "script string, language_code string, language_order int, languages int")


def cue_frame(spark: SparkSession) -> DataFrame:
    """``cue_language, word, is_unique``."""
    unique = fixed.unique_cues()
    return spark.createDataFrame([(k, w, w in unique[k]) for k, ws in fixed.CUES.items() for w in dict.fromkeys(ws)], "cue_language string, word string, is_unique boolean")


def distinctive_sums(chars: Column, script: Column | None = None) -> Column:
    """``map<language, weighted count of its distinctive characters>``, not yet divided.

    ``chars`` is the map of a text's distinctive characters to their numbers, counted once where the text is
    normalised. With ``script`` only languages written in it are looked at; the others' values are null.
    """
    written: dict[str, list[str]] = {}
    for _, language, s, _ in fixed.PROFILES:
        written.setdefault(language, []).append(s)
    items = []
    for language, weights in fixed.DISTINCTIVE.items():
        total = None
        for c, w in weights.items():
            one = F.coalesce(F.element_at(chars, c), F.lit(0)) * F.lit(w)
            total = one if total is None else total + one
        items += [F.lit(language), total if script is None else F.when(script.isin(written[language]), total)]
    return F.create_map(*items)


def cue_scores(features: DataFrame, id_col: str) -> DataFrame:
    """``id, language_code, cue_sum, unique_sum``: cue words found, each three times at most."""
    # words that are no cue stay where they are
    held = sorted({w for ws in fixed.CUES.values() for w in ws})
    words = word_counts(features, [id_col], F.filter("words", lambda w: w.isin(*held)))
    met = words.join(F.broadcast(cue_frame(features.sparkSession)), "word")
    capped = F.least(F.col("cnt"), F.lit(3))
    return met.groupBy(id_col, F.col("cue_language").alias("language_code")).agg(F.sum(capped).alias("cue_sum"), F.sum(F.when(F.col("is_unique"), capped).otherwise(0)).alias("unique_sum"))


def top_text_ngrams(features: DataFrame, id_col: str, keys: list[str] | None = None) -> DataFrame:
    """``id, script, ngram, cnt, rank``: the TOP n-grams of each text."""
    keys = [id_col, *(keys or ["script"])]
    return top_ngrams(ngram_counts(word_counts(features, keys, F.col("words")), keys), keys, TOP).select(*keys, "ngram", "cnt", "rank")


def ngrams_in_rows(docs: DataFrame, id_col: str, text_col: str = "text", path: str = STORE) -> DataFrame:
    """``id, ngram, cnt, rank``: the TOP n-grams of each text, of equals the first seen first; cut and ranked row by row, without a shuffle."""
    ensure_shipped(docs.sparkSession)
    words = spread(docs.select(F.col(id_col), F.col(text_col).alias("_text"))).select(id_col, tx.tokens(tx.normalise(F.col("_text"))).alias("_words"))
    found = words.select(id_col, F.posexplode(inrow.top_ngrams_udf(path)(F.col("_words"))).alias("rank", "_g"))
    return found.select(id_col, "_g.ngram", "_g.cnt", "rank")


def distances_in_rows(docs: DataFrame, id_col: str, text_col: str = "text", path: str = STORE) -> DataFrame:
    """``id, language_code, distance``: as ``rank_distances``, row by row and without a shuffle."""
    ensure_shipped(docs.sparkSession)
    detector = Detector(list(load_profiles(path)))
    held = inrow.features(spread(docs.select(F.col(id_col), F.col(text_col).alias("_text"))), "_text")
    asked = held.where(F.col("_script").isin(*detector.ranks)).select(id_col, "_script", inrow.distances_udf(path)(F.col("_script"), F.col("_words")).alias("_far"))
    codes = F.create_map(*(x for s in detector.ranks for x in (F.lit(s), F.array(*map(F.lit, detector.languages[s])))))
    pairs = F.zip_with(codes[F.col("_script")], "_far", lambda k, d: F.struct(k.alias("language_code"), d.alias("distance")))
    return asked.select(id_col, F.explode(pairs).alias("_p")).select(id_col, "_p.language_code", "_p.distance")


def rank_distances(features: DataFrame, id_col: str, path: str = STORE) -> DataFrame:
    """``id, language_code, distance``: the least rank distance of a language's profiles.

    An n-gram that a profile lacks has the profile's size P as its rank. With m ranked n-grams
    of a text the sum of |i - rank| is that of |i - P| over all i < m, which is known, plus the
    corrections of those that the profile has: an inner join with the broadcast profiles in place of
    an outer join with every candidate. Scripts of one language are left out.
    """
    spark = features.sparkSession
    profiles, ranks = profile_frames(spark, path)
    several = [s for s in charsets.SCRIPTS if len({p["language_code"] for p in load_profiles(path) if p["script"] == s}) > 1]
    asked = features.where(F.col("script").isin(several))
    top = top_text_ngrams(asked, id_col)
    i, p = F.col("rank"), F.col("size")
    ranked = ranks.withColumnRenamed("rank", "profile_rank")
    hits = (
        top.join(F.broadcast(ranked), ["script", "ngram"])
        .groupBy(id_col, "profile_order")
        .agg(F.sum(F.abs(i - F.col("profile_rank")) - F.abs(i - p)).alias("gain"))
    )
    m = top.groupBy(id_col).agg(F.count(F.lit(1)).alias("m"))
    pairs = asked.select(id_col, "script").join(m, id_col, "left").join(F.broadcast(profiles), "script").join(hits, [id_col, "profile_order"], "left")
    m = F.coalesce("m", F.lit(0))
    away = F.when(m <= p, m * p - m * (m - 1) / 2).otherwise(p * (p + 1) / 2 + (m - p - 1) * (m - p) / 2)
    d = F.when(m == 0, 1.0).otherwise((away + F.coalesce("gain", F.lit(0))) / (m * p))
    return pairs.select(id_col, "language_code", d.alias("d")).groupBy(id_col, "language_code").agg(F.min("d").alias("distance"))


def language_scores(docs: DataFrame, id_col: str, text_col: str, path: str = STORE) -> DataFrame:
    """One row per text and candidate language with all that its score is made of."""
    # one shuffle by id serves all that follows, whose groups and joins begin with the id
    features = text_features(docs, id_col, text_col).repartition(id_col)
    light = features.select(id_col, "script", "n_script", "script_share", "n_words", distinctive_sums(F.col("chars"), F.col("script")).alias("sums"))
    pairs = light.where("script is not null").join(F.broadcast(_languages(docs.sparkSession, path)), "script")
    cues, far = cue_scores(features, id_col), rank_distances(features, id_col, path)
    joined = pairs.join(cues, [id_col, "language_code"], "left").join(far, [id_col, "language_code"], "left")
    by_words = F.sqrt(F.greatest(F.lit(1), F.col("n_words")))
    scored = joined.select(
        id_col, "script", "n_script", "script_share", "n_words", "language_code", "language_order",
        F.coalesce("distance", F.lit(0.0)).alias("distance"),
        (F.coalesce(F.element_at("sums", F.col("language_code")), F.lit(0.0)) / F.sqrt(F.greatest(F.lit(1), F.col("n_script")))).alias("distinctive"),
        (F.coalesce("cue_sum", F.lit(0)) / by_words).alias("cue"),
        (F.coalesce("unique_sum", F.lit(0)) / by_words).alias("unique_cue"),
    )
    raw = -7 * F.col("distance") + 1.25 * F.col("distinctive") + 0.9 * F.col("cue") + F.when(F.col("n_words") == 1, 5 * F.col("unique_cue")).otherwise(0.0)
    return scored.withColumn("raw", raw)


def resolved(script: Column, share: Column, n_script: Column, n_words: Column, best: Column) -> Column:
    """Whether a language is named; ``best`` holds top, margin, language_code, distinctive, cue and unique_cue."""
    top, margin, letters, cue, unique = (best[k] for k in ("top", "margin", "distinctive", "cue", "unique_cue"))
    by_length = (
        F.when(share < 0.70, False)
        .when(n_script <= 2, ((letters >= 2.5) & (top >= 0.80)) | ((cue >= 0.9) & (top >= 0.85)))
        .when(n_words <= 1, ((top >= 0.93) & (margin >= 0.60)) | ((letters >= 1.0) & (top >= 0.55)) | ((cue >= 0.9) & (top >= 0.70)))
        .when(n_words <= 3, (top >= 0.66) & (margin >= 0.20))
        .when(n_words >= 1000, (top >= 0.20) & (margin >= 0.10))
        .otherwise((top >= 0.30) & (margin >= 0.05))
    )
    rescued = (script == "Latn") & (n_words <= 3) & (unique >= 0.50) & (top >= 0.30) & (margin >= 0.10)
    needs_proof = (best["language_code"] == "pcm") | (script == "Deva")
    return (by_length | rescued) & (~needs_proof | (letters > 0) | (unique > 0))


def names_of(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*(F.lit(x) for item in table.items() for x in item))[key]


def label_of(script: Column, language: Column) -> Column:
    known = F.coalesce(names_of(fixed.LANGUAGE_NAMES, language), F.lit("uncertain"))
    return F.concat(F.coalesce(names_of(fixed.SCRIPT_NAMES, script), F.lit("Unknown script")), F.lit(" · "), known)


def with_softmax(frame: DataFrame, entries: str, most: str) -> DataFrame:
    """Adds ``ranked``: entries (raw, language_order, language_code, ...) by score, with ``score`` rounded to six places.

    ``most`` is the column of their greatest raw score. Each step is a column that more than one
    other refers to, so that none is evaluated again for every element of the next.
    """
    rest = ("language_code", "distinctive", "cue", "unique_cue")
    ordered = F.sort_array(F.transform(entries, lambda e: F.struct(e["language_order"], e["raw"], *(e[k] for k in rest))))
    out = frame.withColumn("_ordered", ordered)
    out = out.withColumn("_exps", F.transform("_ordered", lambda e: F.struct((-F.exp(e["raw"] - F.col(most))).alias("minus"), e["language_order"].alias("language_order"), *(e[k].alias(k) for k in rest))))
    out = out.withColumn("_total", F.aggregate("_exps", F.lit(0.0), lambda a, e: a - e["minus"]))
    out = out.withColumn("ranked", F.transform(F.sort_array("_exps"), lambda e: F.struct(F.bround(-e["minus"] / F.col("_total"), 6).alias("score"), *(e[k].alias(k) for k in rest))))
    return out


def with_result(frame: DataFrame, out_col: str, prefix: str = "_") -> DataFrame:
    """Replaces what ``inrow.with_entries`` has added by ``out_col``, a struct of DETECTION."""
    p = prefix
    out = frame.withColumn("_most", F.array_max(F.transform(f"{p}entries", lambda e: e["raw"])))
    out = with_softmax(out, f"{p}entries", "_most").drop(f"{p}entries", "_most", "_ordered", "_exps", "_total")
    first, second = F.get("ranked", F.lit(0)), F.coalesce(F.get("ranked", F.lit(1))["score"], F.lit(0.0))
    out = out.withColumn("_best", F.struct(first["score"].alias("top"), (first["score"] - second).alias("margin"), *(first[k].alias(k) for k in ("language_code", "distinctive", "cue", "unique_cue"))))
    script, share = F.col(f"{p}script"), F.col(f"{p}script_share")
    out = out.withColumn("_ok", F.coalesce(resolved(script, share, F.col(f"{p}n_script"), F.col(f"{p}n_words"), F.col("_best")), F.lit(False)))
    language = F.when(F.col("_ok"), F.col("_best.language_code"))
    found = F.struct(
        script.alias("script"), language.alias("language_code"),
        F.coalesce(F.bround(F.when(F.col("_ok"), F.col("_best.top") * share).otherwise(share), 6), F.lit(0.0)).alias("confidence"),
        F.transform("ranked", lambda e: F.struct(e["language_code"].alias("language_code"), e["score"].alias("score"))).alias("alternatives"),
        F.when(F.col("_ok"), "language").when(script.isNotNull(), "script").otherwise("none").alias("resolution"),
        label_of(script, language).alias("label"),
    )
    return out.withColumn(out_col, found).drop("ranked", "_best", "_ok", f"{p}script", f"{p}script_share", f"{p}n_script", f"{p}n_words")


def in_rows(docs: DataFrame, text: Column, out_col: str, path: str = STORE, arrow: bool = True) -> DataFrame:
    """``docs`` with ``out_col``, the detection of ``text``: row by row, without a shuffle; null for a null text.

    Without ``arrow`` all of it is columns in the JVM; with it Arrow batches do the rank distances, which is faster. Columns of ``docs`` may have any names. About sixteen short strings are held for each word of the text at hand;
    ``detect_by_groups`` is there for single texts of many millions of words.
    """
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), text.alias("_text"))
    if arrow:
        ensure_shipped(docs.sparkSession)
    found = with_result(inrow.with_entries(inrow.features(held, "_text"), docs.sparkSession, path, arrow=arrow), "_found")
    kept = (F.col("_row")[c].alias(c) for c in docs.columns if c.lower() != out_col.lower())
    # a filter on the result that is pushed down would compute it again; none passes a column that looks random
    return found.select(*kept, F.when(F.col("_text").isNotNull() & (F.rand(0) >= 0), F.col("_found")).alias(out_col))


def detect(docs: DataFrame, id_col: str, text_col: str = "text", path: str = STORE, arrow: bool = True) -> DataFrame:
    """Detection: ``id`` and the columns of DETECTION, a row per row.

    A null text gives a row of nulls; a text without a letter of a supported script gives resolution ``none``.
    """
    texts_only(docs, text_col)
    found = in_rows(spread(docs.select(F.col(id_col), F.col(text_col).alias("_text_"))), F.col("_text_"), "_d", path, arrow)
    return found.select(id_col, "_d.*")


def detect_by_groups(docs: DataFrame, id_col: str, text_col: str = "text", path: str = STORE) -> DataFrame:
    """The same by grouping rows of n-grams, one row per id: a text is never whole in one task once it is cut into words.

    Needs a unique, non-null id. A null text gives a row of nulls; a text without a letter of a supported script
    gives resolution ``none``. At most 17 candidate languages are gathered per text.
    """
    ensure_shipped(docs.sparkSession)
    texts_only(docs, text_col)
    scores = language_scores(docs, id_col, text_col, path)
    entry = F.struct("raw", "language_order", "language_code", "distinctive", "cue", "unique_cue")
    per = scores.groupBy(id_col, "script", "n_script", "script_share", "n_words").agg(F.collect_list(entry).alias("entries"), F.max("raw").alias("most"))
    ranked = with_softmax(per, "entries", "most").where(F.col("_total") > 0)
    first = F.element_at("ranked", 1)
    second = F.when(F.size("ranked") > 1, F.element_at("ranked", 2)["score"]).otherwise(0.0)
    best = F.struct(first["score"].alias("top"), (first["score"] - second).alias("margin"), *(first[k].alias(k) for k in ("language_code", "distinctive", "cue", "unique_cue")))
    decided = ranked.withColumn("best", best).withColumn("ok", resolved(F.col("script"), F.col("script_share"), F.col("n_script"), F.col("n_words"), F.col("best")))
    language = F.when(F.col("ok"), F.col("best.language_code"))
    found = decided.select(
        id_col, "script", language.alias("language_code"),
        F.bround(F.when(F.col("ok"), F.col("best.top") * F.col("script_share")).otherwise(F.col("script_share")), 6).alias("confidence"),
        F.transform("ranked", lambda e: F.struct(e["language_code"].alias("language_code"), e["score"].alias("score"))).alias("alternatives"),
        F.when(F.col("ok"), "language").otherwise("script").alias("resolution"),
        label_of(F.col("script"), language).alias("label"),
    )
    out = docs.select(F.col(id_col), F.col(text_col).isNull().alias("_null")).join(found, id_col, "left")
    there = ~F.col("_null")
    fill = {"confidence": F.lit(0.0), "alternatives": F.array().cast("array<struct<language_code:string,score:double>>"), "resolution": F.lit("none"), "label": F.lit("Unknown script · uncertain")}
    return out.select(id_col, "script", "language_code", *(F.when(there, F.coalesce(F.col(c), v)).alias(c) for c, v in fill.items()))


# --- row-local form --------------------------------------------------------------------------


def detection_udf(path: str = STORE):
    """``text -> struct`` of DETECTION, by Arrow batches. No shuffle, so it serves streams and is the
    faster form for batches; the profiles travel with the function."""
    detector = Detector(list(load_profiles(path)))

    @pandas_udf(DETECTION)
    def run(text: pd.Series) -> pd.DataFrame:
        rows = detector.detect_all(text.tolist())
        return pd.DataFrame([r or dict.fromkeys(_FIELDS) for r in rows], columns=_FIELDS)

    return run


_FIELDS = ["script", "language_code", "confidence", "alternatives", "resolution", "label"]
_MIXED_FIELDS = ["primary", "segments", "scripts", "language_codes", "is_mixed_script", "is_mixed_language", "is_mixed", "has_unresolved_segments"]


def mixed_udf(path: str = STORE):
    """``text -> struct`` of MIXED."""
    detector = Detector(list(load_profiles(path)))

    @pandas_udf(MIXED)
    def run(text: pd.Series) -> pd.DataFrame:
        rows = detector.mixed_all(text.tolist())
        return pd.DataFrame([r or dict.fromkeys(_MIXED_FIELDS) for r in rows], columns=_MIXED_FIELDS)

    return run


def _whole(struct: Column, text: Column) -> Column:
    return F.when(text.isNotNull(), struct)


def with_detection(docs: DataFrame, text_col: str = "text", out_col: str = "detection", path: str = STORE) -> DataFrame:
    """``docs`` with a detection struct, null for null texts. Works on streams."""
    return in_rows(spread(texts_only(docs, text_col)), F.col(text_col), out_col, path)


def with_mixed(docs: DataFrame, text_col: str = "text", out_col: str = "mixed", path: str = STORE) -> DataFrame:
    """``docs`` with whole-text detection and ordered spans. Works on streams."""
    ensure_shipped(docs.sparkSession)
    return spread(texts_only(docs, text_col)).withColumn(out_col, _whole(mixed_udf(path)(F.col(text_col)), F.col(text_col)))


def register(spark: SparkSession, path: str = STORE) -> None:
    """SQL functions ``detect_language(text)``, ``detect_mixed(text)`` and table function ``detect_spans(text)``."""
    from pyspark.sql.functions import udtf

    ensure_shipped(spark)
    detector = Detector(list(load_profiles(path)))

    class Spans:
        def eval(self, text):
            for s in detector.spans(text) if text is not None else ():
                yield tuple(s[k] if k != "alternatives" else [(a["language_code"], a["score"]) for a in s[k]] for k in ("start", "end", "text", *_FIELDS))

    spark.udf.register("detect_language", detection_udf(path))
    spark.udf.register("detect_mixed", mixed_udf(path))
    spark.udtf.register("detect_spans", udtf(Spans, returnType=SEGMENT.replace(" end ", " `end` ")))
