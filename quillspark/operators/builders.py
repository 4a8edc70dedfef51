"""Case sets and training samples put together from sentence sources and a registry.

A registry says what each source's file is: a DataFrame of ``code`` (the file's), ``prefix`` (of case ids, unique), ``language``,
``language_name``, ``script`` and, where they apply, ``alphabet``, ``variety``, ``min_share`` (least share of the script in
a case) and ``lexical_only`` (words without a letter are left out first). It is a list of languages, hence small.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.transliterate import uyghur_cyrillic, uyghur_new_script
from ..sources.readers import cyrillic_majority, require_digest
from . import sampling as sm

OPTIONAL = {"alphabet": "string", "variety": "string", "min_share": "double", "lexical_only": "boolean"}


def chosen(registry: DataFrame, only: Iterable[str] | None = None, column: str = "language") -> DataFrame:
    """The registry's rows of the named languages, all without names; its optional columns are added where absent."""
    for name, kind in OPTIONAL.items():
        if name not in registry.columns:
            registry = registry.withColumn(name, F.lit(None).cast(kind))
    return registry if only is None else registry.where(F.col(column).isin(*only))


def sentence_cases(lines: DataFrame, registry: DataFrame, source: dict[str, Column], seed: str = "cases", seed_key: Column | None = None, lengths=sm.LENGTHS, per_length: int = 5, only: Iterable[str] | None = None, ids: bool = False) -> DataFrame:
    """Cases of every length for each registered source of ``lines`` (code, line, text).

    ``seed_key`` names the random numbers of a source (its code by default). ``source`` are the fields that a case's
    ``source`` states besides first and last sentence; with ``ids`` those give way to the list of ``line`` values.
    Sources without lines give no case.
    """
    wanted = chosen(registry, only).withColumn("seed_key", F.col("code") if seed_key is None else seed_key)
    words = tx.split_words(F.col("text"))
    text = F.when(F.col("lexical_only"), F.array_join(tx.lexical_words(F.col("text")), " ")).otherwise(F.col("text"))
    given = lines.select("code", "line", "text").where(F.size(words) > 0).join(F.broadcast(wanted), "code")
    given = given.select("prefix", "seed_key", "script", "min_share", F.col("line").cast("long").alias("line"), text.alias("text")).where(F.size(words) > 0)

    found = sm.windows(given, "prefix", seed, lengths, per_length, seed_key="seed_key", script="script", least="min_share")
    found = found.select(F.col("key").alias("prefix"), "word_count", "number", "text", F.col("line_start").alias("sentence_start"), F.col("line_end").alias("sentence_end"), F.col("places").alias("sentence_ids"))
    found = found.join(F.broadcast(wanted), "prefix")
    place = [F.col("sentence_ids")] if ids else [F.col("sentence_start"), F.col("sentence_end")]
    stated = F.struct(*(c.alias(k) for k, c in source.items()), *place).alias("source")
    named = sm.case_ids(found, "").withColumn("id", F.concat("prefix", "id"))
    return named.select("id", F.col("language").alias("expected_language"), "language_name", "script", "alphabet", "variety", "word_count", "text", stated)


def flores_cases(lines: DataFrame, registry: DataFrame, split: str = "devtest", **options) -> DataFrame:
    """Cases from the sentence files of an archive (``readers.read_archive_sentences``)."""
    return sentence_cases(lines, registry, {"dataset": F.lit("FLORES-200"), "split": F.lit(split), "flores_code": F.col("code")}, **options)


def treebank_cases(sentences: DataFrame, registry: DataFrame, code: str, url: str, commit: str, split: str = "test", **options) -> DataFrame:
    """Cases from one treebank (``readers.read_conllu_sentences``), which the registry knows by ``code``."""
    lines = sentences.withColumn("code", F.lit(code))
    fields = {"dataset": F.lit("NaijaSynCor"), "split": F.lit(split), "source_url": F.lit(url), "source_commit": F.lit(commit)}
    return sentence_cases(lines, registry, fields, **options)


def export_cases(export: DataFrame, registry: DataFrame, url: str, digest: str, files: DataFrame | None = None, **options) -> DataFrame:
    """Cases from the Cyrillic sentences of a per-language export (``readers.read_sentence_export``), in order of id.

    The registry's ``code`` is the export's language. ``files`` (``readers.file_digests``) are held against ``digest``.
    """
    if files is not None:
        require_digest(files, {r.path.rsplit("/", 1)[-1]: digest for r in files.select("path").collect()}).foreach(lambda r: None)
    lines = export.where(cyrillic_majority(F.col("text"))).select(F.col("language").alias("code"), F.col("sentence_id").alias("line"), "text")
    fields = {"dataset": F.lit("Tatoeba"), "split": F.lit("per_language_export"), "language_code": F.col("code"), "source_url": F.lit(url), "archive_sha256": F.lit(digest)}
    return sentence_cases(lines, registry, fields, ids=True, **options)


def sentence_samples(lines: DataFrame, registry: DataFrame, words: int = 1000, only: Iterable[str] | None = None) -> DataFrame:
    """Training samples of sentence files: ``language, sample_file, sample_word_count, code, variety, text``.

    The registry's ``language`` is a sample's folder, ``prefix`` the name of its file.
    """
    wanted = chosen(registry, only).select("code", "language", "prefix", "variety")
    texts = sm.line_samples(lines.join(F.broadcast(wanted.select("code")), "code", "left_semi"), "code", words)
    counted = texts.withColumn("sample_word_count", F.size(tx.split_words(F.col("text"))))
    return counted.join(F.broadcast(wanted), "code").select("language", F.col("prefix").alias("sample_file"), "sample_word_count", "code", "variety", "text")


def declaration_samples(pages: DataFrame, registry: DataFrame, html: str = "html", words: int = 1000, only: Iterable[str] | None = None) -> DataFrame:
    """Training samples of HTML pages (code, html), laid out in paragraphs, in the same columns.

    A sample in Uyghur Arabic letters is spelled in Cyrillic and in the new script too, which the script's tag after its file's name says.
    """
    wanted = chosen(registry, only).select("code", "language", "script", "prefix", "variety")
    rows = sm.page_samples(pages.join(F.broadcast(wanted.select("code")), "code", "left_semi"), "code", html, words)
    rows = rows.withColumnRenamed("label", "code").join(F.broadcast(wanted), "code")
    text = F.col("text")
    spelled = F.when((F.col("language") == "uyghur") & (F.col("script") == "Arab"), F.create_map(F.lit(""), text, F.lit("_cyrillic"), uyghur_cyrillic(text), F.lit("_new_script"), uyghur_new_script(text))).otherwise(F.create_map(F.lit(""), text))
    out = rows.select("code", "language", "prefix", "variety", F.explode(spelled).alias("tag", "text"))
    return out.select("language", F.concat("prefix", "tag").alias("sample_file"), F.size(tx.split_words(F.col("text"))).alias("sample_word_count"), "code", "variety", "text")
