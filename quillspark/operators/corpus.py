"""Corpus statistics by sample: letters, words, bigrams, exclusive letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import charsets
from ..functions import text as tx
from ..resources import fixed

# Characters that tell neighbouring orthographies apart, by group.
DIAGNOSTIC = {
    "Arabic-script": "ةأإآؤئءىكکيیۀپچژگٹڈڑںھہےټځڅډړږښګڼېۍەڭۆۇۈۋ",
    "Hebrew-script": "ךםןףץװױײ",
    "Cyrillic-script": "ёыэъщцґєіїғӣқӯҳҷўәҗңөүһ",
    "Latin-script": "qwxʻʼëéöüçğışəƣɵⱨⱪⱬ",
}


def long_script_name(char: Column) -> Column:
    """Script of a letter by its long name; kana do not decide about Han here; others are ``Other``."""
    out = F.lit("Other")
    for s in reversed(charsets.SCRIPTS):
        name = "Japanese" if s == "Jpan" else fixed.SCRIPT_NAMES[s]
        out = F.when(char.rlike(charsets.java_class(s)), name).otherwise(out)
    return out


def char_counts(docs: DataFrame, sample: str, text: str) -> DataFrame:
    """``sample, char, n``: letters of NFC, case-folded text.

    Each task adds up its characters as they come, by hashing, so that only its sums are shuffled.
    """
    norm = docs.select(F.col(sample).alias("sample"), tx.nfc_casefold(F.col(text)).alias("norm"))
    chars = norm.select("sample", F.explode(F.split("norm", "")).alias("char"))
    counts = chars.groupBy("sample", "char").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("char").rlike(charsets.java_class("letter")))


def script_shares(letters: DataFrame) -> DataFrame:
    """``sample, script, n, share`` of letters."""
    per = letters.groupBy("sample", long_script_name(F.col("char")).alias("script")).agg(F.sum("n").alias("n"))
    return per.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("sample")))


def dominant_scripts(letters: DataFrame) -> DataFrame:
    """``sample, script``: the most frequent; of equals the first by name."""
    shares = script_shares(letters)
    return shares.groupBy("sample").agg(F.min_by("script", F.struct(-F.col("n"), F.col("script"))).alias("script"))


def exclusive_letters(letters: DataFrame) -> DataFrame:
    """``sample, script, char, n``: letters that no other sample of the same dominant script has.

    That is: letters with one owner among the samples of a script, so one aggregation does it.
    """
    owned = letters.join(dominant_scripts(letters), "sample")
    sole = owned.groupBy("script", "char").agg(F.count(F.lit(1)).alias("owners")).where("owners = 1")
    return owned.join(sole, ["script", "char"]).select("sample", "script", "char", "n")


def ranked(counts: DataFrame, keys: list[str], value: str, k: int) -> DataFrame:
    """The ``k`` most frequent of each group; of equals the least value first."""
    order = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), F.asc(value)))
    return counts.withColumn("rank", order).where(F.col("rank") <= k)


def sample_words(docs: DataFrame, sample: str, order: str, text: str) -> DataFrame:
    """``sample, doc, words``: words of each text, in the sample's order of texts."""
    return docs.select(F.col(sample).alias("sample"), F.col(order).alias("doc"), tx.tokens(tx.nfc_casefold(F.col(text))).alias("words"))


def top_words(words: DataFrame, k: int = 15) -> DataFrame:
    """``sample, word, n, rank``."""
    counts = words.select("sample", F.explode("words").alias("word")).groupBy("sample", "word").agg(F.count(F.lit(1)).alias("n"))
    return ranked(counts, ["sample"], "word", k)


def top_bigrams(words: DataFrame, k: int = 8) -> DataFrame:
    """``sample, bigram, n, rank``: pairs of words that follow each other, across lines of a text."""
    pairs = F.zip_with(F.slice("words", 1, F.greatest(F.size("words") - 1, F.lit(0))), F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    counts = words.select("sample", F.explode(pairs).alias("bigram")).groupBy("sample", "bigram").agg(F.count(F.lit(1)).alias("n"))
    return ranked(counts, ["sample"], "bigram", k)


def diagnostic_counts(letters: DataFrame) -> DataFrame:
    """``kind, sample, char, n`` of the diagnostic characters that are there."""
    listed = letters.sparkSession.createDataFrame([(g, c, i) for g, chars in DIAGNOSTIC.items() for i, c in enumerate(chars)], "kind string, char string, place int")
    return letters.join(F.broadcast(listed), "char").select("kind", "sample", "char", "place", "n")


def format_counts(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, counts``: ranked values as ``value:n value:n``."""
    items = F.transform(F.array_sort(F.collect_list(F.struct("rank", value, "n"))), lambda x: F.concat(x[value], F.lit(":"), x["n"].cast("string")))
    return rows.groupBy(*keys).agg(F.array_join(items, " ").alias("counts"))
