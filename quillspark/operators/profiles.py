"""n-gram profiles: training, storing and loading."""

from __future__ import annotations

import json
import os
import sys
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..resources import fixed

PROFILE_SIZE = 800
STORE = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "resources", "profiles.json")


def word_counts(docs: DataFrame, keys: list[str], words: Column, order: str | None = None) -> DataFrame:
    """``keys, word, cnt, first``: words of each document and where each is seen first.

    With ``order`` the rows of a key are one text in that order, and ``first`` is (order, place).
    """
    if order and isinstance(docs.schema[order].dataType, T.IntegralType):
        return _ordered_counts(docs, keys, words, order)
    extra = [order] if order else []
    at = F.struct(order, "pos") if order else F.col("pos")
    return docs.select(*keys, *extra, F.posexplode(words).alias("pos", "word")).groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("cnt"), F.min(at).alias("first"))


def _ordered_counts(docs: DataFrame, keys: list[str], words: Column, order: str) -> DataFrame:
    """``word_counts`` in the order of whole numbers: (order, place) is one number while words are added up, since a minimum of structs would sort every word."""
    span, none = F.lit(str(1 << 32)).cast("decimal(10,0)"), F.lit(str(-(1 << 63) - 1)).cast("decimal(20,0)")
    at = F.coalesce(F.col(order).cast("decimal(20,0)"), none) * span + F.col("pos")
    rows = docs.select(*keys, order, F.posexplode(words).alias("pos", "word")).select(*keys, "word", at.alias("at"))
    counts = rows.groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("cnt"), F.min("at").alias("at"))
    pos = F.pmod(F.col("at"), span)
    first = F.nullif((F.col("at") - pos) / span, none).cast(docs.schema[order].dataType)
    return counts.select(*keys, "word", "cnt", F.struct(first.alias(order), pos.cast("int").alias("pos")).alias("first"))


def ngram_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, ngram, cnt, first`` from word counts, so that a repeated word is cut once.

    ``first`` is (word, place in the word): an n-gram's first occurrence lies in the
    first one of the earliest word that holds it. Both numbers are packed into one, since a minimum
    of structs would make the aggregation sort.
    """
    cut = counts.select(*keys, "cnt", "first", F.posexplode(tx.ngrams(F.col("word"))).alias("off", "ngram"))
    several = isinstance(counts.schema["first"].dataType, T.StructType)
    at = F.struct("first", "off") if several else F.shiftleft(F.col("first").cast("long"), 32) + F.col("off")
    return cut.groupBy(*keys, "ngram").agg(F.sum("cnt").alias("cnt"), F.min(at).alias("first"))


def top_ngrams(grams: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The ``k`` most frequent n-grams with their rank from 0; of equals the first seen first."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("cnt"), F.asc("first"))) - 1
    return grams.withColumn("rank", rank).where(F.col("rank") < k)


def build_profiles(samples: DataFrame, keys: list[str], text: str = "text", size: int = PROFILE_SIZE, order: str | None = None) -> DataFrame:
    """``keys, ngram, cnt, rank``: the profile of each sample; of equally frequent n-grams the first seen is first.

    Samples with equal keys are one, read in the order of the column ``order``; without it keys are unique.
    """
    words = word_counts(samples, keys, tx.tokens(tx.normalise(F.col(text))), order)
    return top_ngrams(ngram_counts(words, keys), keys, size).select(*keys, "ngram", "cnt", "rank")


@lru_cache(maxsize=4)
def load_profiles(path: str = STORE) -> tuple:
    """Stored profiles in registration order."""
    with open(path, encoding="utf-8") as f:
        stored = json.load(f)["profiles"]
    return tuple({"profile_key": k, "order": i, **v} for i, (k, v) in enumerate(stored.items()))


def profile_frames(spark: SparkSession, path: str = STORE) -> tuple[DataFrame, DataFrame]:
    """(profiles, their ranked n-grams), both of a size that the store bounds."""
    stored = load_profiles(path)
    profiles = spark.createDataFrame(
        [(p["profile_key"], p["order"], p["language_code"], p["script"], len(p["ngrams"])) for p in stored],
        "profile_key string, profile_order int, language_code string, script string, size int",
    )
    ranks = spark.createDataFrame([(p["order"], p["script"], g, r, len(p["ngrams"])) for p in stored for r, g in enumerate(p["ngrams"])], "profile_order int, script string, ngram string, rank int, size int")
    return profiles, ranks


def store_profiles(spark: SparkSession, corpora: str, path: str = STORE, size: int = PROFILE_SIZE) -> list[str]:
    """Train a profile for every registered sample below ``corpora`` and store them.

    A script of one language needs no n-grams to tell languages apart: if its sample is
    missing, its profile holds a single entry. Returns the keys of missing samples.
    """
    from ..sources.readers import read_samples

    registered = spark.createDataFrame([(k, p) for k, _, _, p in fixed.PROFILES], "profile_key string, path string")
    samples = read_samples(spark, corpora).join(F.broadcast(registered), "path").select("profile_key", "text")
    rows = build_profiles(samples, ["profile_key"], size=size).collect()
    ngrams: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["profile_key"], r["rank"])):
        ngrams.setdefault(r["profile_key"], []).append(r["ngram"])
    out = {k: {"language_code": language, "script": script, "ngrams": ngrams.get(k, ["^$"])} for k, language, script, _ in fixed.PROFILES}
    with open(path, "w", encoding="utf-8") as f:
        f.write('{"version": 1, "profiles": {\n')
        f.write(",\n".join(f"{json.dumps(k)}: {json.dumps(v, ensure_ascii=False)}" for k, v in out.items()))
        f.write("\n}}\n")
    load_profiles.cache_clear()
    return [k for k in out if k not in ngrams]


if __name__ == "__main__":
    from ..shipping import ensure_shipped

    session = SparkSession.builder.getOrCreate()
    ensure_shipped(session)
    print("missing:", store_profiles(session, sys.argv[1]))
