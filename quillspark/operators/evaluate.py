"""Evaluation of detections against expected languages."""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import percentage
from ..resources import fixed
from .detect import names_of, with_detection

LANGUAGE_FIELDS = ("language_code", "language", "code")
SCRIPT_FIELDS = ("script", "alphabet", "script_code")
UNKNOWN = ("", "und", "unknown", "uncertain")


def normalise_script(value: Column) -> Column:
    """The four-letter code of a known spelling, any other value as it is."""
    return F.coalesce(names_of(fixed.SCRIPT_ALIASES, F.lower(F.trim(value))), value)


def normalise_language(value: Column) -> Column:
    low = F.lower(F.trim(value))
    return F.when(~low.isin(*UNKNOWN), low)


def _first_named(names: tuple[str, ...], there, value) -> Column:
    """The value of the first name that is there, even if that value is null."""
    out = F.lit(None).cast("string")
    for name in reversed(names):
        out = F.when(there(name), value(name).cast("string")).otherwise(out)
    return out


def parse_prediction(frame: DataFrame, column: str) -> tuple[Column, Column]:
    """(language, script) of a prediction column: a code, or a struct, map or variant in which they are found by name.

    The first name that is there counts, even where its value is null; what is there is known by the type of a struct, and
    row by row of a map or a variant. An array counts by its first element. A bare string that names a script is one. Without a
    script, that of the language counts if it has one only.
    """
    kind, value = frame.schema[column].dataType, F.col(column)
    if isinstance(kind, T.ArrayType):
        kind, value = kind.elementType, F.get(value, F.lit(0))
    none = F.lit(None).cast("string")
    if isinstance(kind, T.StringType):
        language, script = _bare(value)
    elif isinstance(kind, T.StructType):
        if not {*LANGUAGE_FIELDS, *SCRIPT_FIELDS} & {*kind.names}:
            raise ValueError(f"no language and no script among {kind.names}")
        pick = lambda names: _first_named(tuple(n for n in names if n in kind.names), lambda n: F.lit(True), lambda n: value[n])
        language, script = pick(LANGUAGE_FIELDS), pick(SCRIPT_FIELDS)
    elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        pick = lambda names: _first_named(names, lambda n: F.coalesce(F.map_contains_key(value, n), F.lit(False)), lambda n: F.try_element_at(value, F.lit(n)))
        language, script = pick(LANGUAGE_FIELDS), pick(SCRIPT_FIELDS)
    elif isinstance(kind, T.VariantType):
        at = lambda path, to="string": F.try_variant_get(value, path, to)
        pick = lambda names: _first_named(names, lambda n: at(f"$.{n}", "variant").isNotNull(), lambda n: at(f"$.{n}"))
        shape = F.schema_of_variant(value)
        bare, listed = shape == "STRING", shape.startswith("ARRAY")
        as_text = _bare(at("$"))
        language = F.when(bare, as_text[0]).when(listed, at("$[0]")).otherwise(pick(LANGUAGE_FIELDS))
        script = F.when(bare, as_text[1]).when(listed, none).otherwise(pick(SCRIPT_FIELDS))
    else:
        raise TypeError(f"a prediction is a string, a struct, a map or a variant, not {kind.simpleString()}")
    language = normalise_language(language)
    return language, F.coalesce(normalise_script(script), names_of(fixed.LANGUAGE_SCRIPTS, language))


def _bare(value: Column) -> tuple[Column, Column]:
    """A string by itself: the name of a script, or a language."""
    script = names_of(fixed.SCRIPT_ALIASES, F.lower(F.trim(value)))
    return F.when(script.isNull(), value), script


def evaluate(cases: DataFrame, detector: Callable[[DataFrame], DataFrame] | None = None, column: str = "detection") -> DataFrame:
    """Cases with ``predicted_language, predicted_script, language_correct, script_correct, resolution``.

    ``detector`` adds a prediction column to a DataFrame; without one it is this engine.
    """
    frame = (detector or with_detection)(cases)
    language, script = parse_prediction(frame, column)
    rows = frame.withColumns({"predicted_language": language, "predicted_script": script}).drop(column)
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    rows = rows.withColumns({"language_correct": same("predicted_language", "expected_language"), "script_correct": same("predicted_script", "script")})
    kind = F.when(F.col("language_correct") & F.col("script_correct"), "language").when(F.col("predicted_language").isNull() & F.col("script_correct"), "script").otherwise("wrong")
    return rows.withColumn("resolution", kind)


def _measures() -> list[Column]:
    n = F.count(F.lit(1))
    tried = F.count_if(F.col("predicted_language").isNotNull())
    return [
        n.alias("cases"),
        F.count_if(F.col("resolution") == "language").alias("exact"),
        F.count_if(F.col("resolution") == "script").alias("script_only"),
        F.count_if(F.col("resolution") == "wrong").alias("wrong"),
        tried.alias("attempted"),
        F.count_if(F.col("language_correct")).alias("language_correct"),
        F.count_if(F.col("script_correct")).alias("script_correct"),
    ]


def totals(rows: DataFrame) -> DataFrame:
    """One row of counts, with shares as text."""
    return with_shares(rows.agg(*_measures()))


def with_shares(counts: DataFrame) -> DataFrame:
    """Counts with their shares as text."""
    n = F.col("cases")
    return counts.withColumns({"exact_share": percentage(F.col("exact"), n), "useful_share": percentage(F.col("exact") + F.col("script_only"), n), "coverage": percentage(F.col("attempted"), n), "accuracy_when_attempted": percentage(F.col("language_correct"), F.col("attempted")), "script_accuracy": percentage(F.col("script_correct"), n)})


SETS = (("word_count",), ("expected_language",), ("expected_language", "script"), ("expected_language", "variety"), ("expected_language", "alphabet"))


def breakdown(rows: DataFrame, sets=SETS) -> DataFrame:
    """The counts by several groupings at once (GROUPING SETS), named by ``grouping``.

    Members that are null themselves are left out, which grouping ids tell from absent ones.
    """
    columns = list(dict.fromkeys(c for s in sets for c in s))
    grouped = rows.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(*_measures(), F.grouping_id(*columns).alias("gid"))
    ids = {"/".join(s): sum((c not in s) << (len(columns) - 1 - i) for i, c in enumerate(columns)) for s in sets}
    name, keep = F.lit(None).cast("string"), F.lit(False)
    for label, gid in ids.items():
        members = F.lit(True)
        for c in label.split("/"):
            members = members & F.col(c).isNotNull()
        name = F.when(F.col("gid") == gid, label).otherwise(name)
        keep = keep | ((F.col("gid") == gid) & members)
    return grouped.where(keep).select(name.alias("grouping"), *columns, *(c for c in grouped.columns if c not in (*columns, "gid")))


def confusions(rows: DataFrame) -> DataFrame:
    """``expected_language, predicted, n`` of wrong rows, the most frequent first.

    Wrong rows are counted and not filtered: a filter on what follows from a detection lets Spark infer constraints
    through all the columns it is made of, and planning does not end.
    """
    pairs = rows.groupBy("expected_language", F.coalesce("predicted_language", F.lit("und")).alias("predicted"))
    wrong = pairs.agg(F.count_if(F.col("resolution") == "wrong").alias("n")).where("n > 0")
    return wrong.orderBy(F.desc("n"), "expected_language", "predicted")


def violations(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """``check, n``: rows that break each of the named conditions. All must be 0."""
    counted = rows.agg(*(F.count_if(~F.coalesce(c, F.lit(False))).alias(k) for k, c in checks.items()))
    return counted.select(F.explode(F.array(*(F.struct(F.lit(k).alias("check"), F.col(k).alias("n")) for k in checks))).alias("v")).select("v.*")


def bucket_differences(cases: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, n, expected``: buckets whose number of cases is not the one that ``expected`` (keys, n) states; 0 where one side has none."""
    found = cases.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    both = found.join(expected.withColumnRenamed("n", "expected"), keys, "full")
    return both.fillna(0, ["n", "expected"]).where("n <> expected")


def overlaps(cases: DataFrame, key: str, start: str, end: str, after: int = 0) -> DataFrame:
    """Cases whose range begins at ``after`` or before it, or not behind the end of the one before it in its ``key``."""
    before = F.lag(end).over(Window.partitionBy(key).orderBy(start, end))
    return cases.withColumn("previous_end", F.coalesce(before, F.lit(after))).where(F.col(start) <= F.col("previous_end"))


def duplicates(rows: DataFrame, column: str) -> DataFrame:
    """Values that occur more than once. Hashes are counted first, so that only values with an equal hash are compared as a whole."""
    hashed = rows.select(column, F.xxhash64(column).alias("_hash"))
    again = hashed.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_hash")
    return hashed.join(again, "_hash", "left_semi").groupBy(column).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def detector_named(name: str) -> Callable[[DataFrame], DataFrame]:
    """The function ``package.module:function``, which adds a prediction column to a DataFrame."""
    module, _, function = name.partition(":")
    found = getattr(importlib.import_module(module), function) if module and function else None
    if not callable(found):
        raise ValueError(f"{name!r} is no package.module:function")
    return found


def report(rows: DataFrame) -> dict[str, DataFrame]:
    """The tables of an evaluation by name. The rows serve all of them, so cache them or write them first."""
    return {"totals": totals(rows), "groups": breakdown(rows).orderBy("grouping", *dict.fromkeys(c for s in SETS for c in s)), "confusions": confusions(rows)}


def main(arguments: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Command line: evaluate a detector over a file of cases and print the tables."""
    from ..shipping import ensure_shipped
    from ..sources.readers import read_cases

    parser = argparse.ArgumentParser(prog="python -m quillspark.operators.evaluate")
    parser.add_argument("--cases", required=True, help="JSON lines, a case each")
    parser.add_argument("--detector", help="package.module:function from DataFrame to DataFrame; this engine if absent")
    parser.add_argument("--column", default="detection", help="the column that the detector adds")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    ensure_shipped(spark)
    try:
        detector = detector_named(given.detector) if given.detector else None
    except (ImportError, AttributeError, ValueError) as error:
        parser.error(f"cannot load detector {given.detector}: {error}")
    tables = report(evaluate(read_cases(spark, given.cases), detector, given.column).cache())
    for name, table in tables.items():
        print(name)
        table.show(1000, truncate=False)
    return tables


if __name__ == "__main__":
    main()
