"""Sinks: profiles, samples, cases and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_cases(cases: DataFrame, path: str) -> None:
    """One JSON object per line in order of id: files follow each other in that order, one for a small set."""
    cases.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").option("ignoreNullFields", True).json(path)


def write_samples(samples: DataFrame, path: str, label: str = "label", text: str = "text") -> None:
    """Sample texts, a folder for each label."""
    samples.select(F.col(label).alias("label"), F.col(text).alias("value")).write.mode("overwrite").partitionBy("label").text(path)


def write_sample_metadata(samples: DataFrame, path: str, language: str = "language", **facts: str) -> None:
    """A JSON object for each language: where its samples come from (``facts``: source, split, license, ...),
    and the other columns of ``samples`` but their text as a list. A language has a handful of samples."""
    rest = [c for c in samples.columns if c not in (language, "text")]
    listed = samples.groupBy(F.col(language).alias("language")).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("samples"))
    stated = [F.lit(v).alias(k) for k, v in facts.items()]
    when = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("retrieved_at")
    folder = F.col("language").alias("folder")
    listed.select("language", when, *stated, "samples", folder).repartition("folder").write.mode("overwrite").partitionBy("folder").json(path)


def write_profiles(profiles: DataFrame, path: str) -> None:
    """Profile n-grams with their ranks, as a columnar table."""
    profiles.write.mode("overwrite").parquet(path)


def as_json(result: Column) -> Column:
    """A result column as JSON, with nulls written out."""
    return F.to_json(result, {"ignoreNullFields": "false"})
