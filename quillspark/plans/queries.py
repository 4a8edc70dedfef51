"""The registered queries over the driver's tables, and the SQL that DuckDB can run for them."""

from __future__ import annotations

import unicodedata
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import charsets
from ..functions import text as tx
from ..functions.transliterate import uyghur_cyrillic, uyghur_latin, uyghur_new_script
from ..operators import corpus as cp
from ..operators import detect as dt
from ..operators import evaluate as ev
from ..operators import inrow
from ..operators import mixed as mx
from ..operators import profiles as pf
from ..operators import sampling as sm
from ..resources import fixed
from ..shipping import ensure_shipped, spread
from ..sources.readers import paragraphs
from . import oracle


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_shipped(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def normalize_text(spark, sf_dir):
    return spread(documents(spark, sf_dir)).select("doc_id", tx.normalise(F.col("text")).alias("norm"))


def tokenize(spark, sf_dir):
    """Every word with its place."""
    words = spread(documents(spark, sf_dir)).select("doc_id", tx.tokens(tx.normalise(F.col("text"))).alias("words"))
    return words.select("doc_id", F.posexplode("words").alias("pos", "word"))


def token_stats(spark, sf_dir):
    words = spread(documents(spark, sf_dir)).select("doc_id", tx.tokens(tx.normalise(F.col("text"))).alias("w"))
    longest = F.coalesce(F.array_max(F.transform("w", lambda x: F.length(x))), F.lit(0))
    return words.select("doc_id", F.size("w").cast("long").alias("n_words"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"), longest.cast("long").alias("longest"))


def script_letter_counts(spark, sf_dir):
    counts = spread(documents(spark, sf_dir)).select("doc_id", tx.script_counts(tx.normalise(F.col("text"))).alias("c"))
    return counts.select("doc_id", *(F.col(f"c.{s}").alias(s.lower()) for s in charsets.SCRIPTS))


def dominant_script(spark, sf_dir):
    f = dt.text_features(documents(spark, sf_dir), "doc_id", "text")
    return f.select("doc_id", "script", "n_script", F.bround("script_share", 6).alias("script_share"), F.col("n_words").cast("long").alias("n_words"))


def ngram_counts(spark, sf_dir):
    """How often and in how many texts every n-gram occurs."""
    return inrow.gram_totals(spread(documents(spark, sf_dir)), tx.tokens(tx.normalise(F.col("text"))))


def ngram_top300(spark, sf_dir):
    return dt.ngrams_in_rows(documents(spark, sf_dir), "doc_id")


def cue_scores(spark, sf_dir):
    f = dt.text_features(documents(spark, sf_dir), "doc_id", "text")
    return dt.cue_scores(f, "doc_id").select("doc_id", "language_code", F.col("cue_sum").cast("long").alias("cue_sum"), F.col("unique_sum").cast("long").alias("unique_sum"))


def distinctive_scores(spark, sf_dir):
    f = dt.text_features(documents(spark, sf_dir), "doc_id", "text")
    sums = f.select("doc_id", F.explode(dt.distinctive_sums(F.col("chars"))).alias("language_code", "weight"))
    return sums.where("weight > 0").select("doc_id", "language_code", F.bround("weight", 4).alias("weight"))


def rank_distance(spark, sf_dir):
    return dt.distances_in_rows(documents(spark, sf_dir), "doc_id").select("doc_id", "language_code", F.bround("distance", 9).alias("distance"))


def build_profiles(spark, sf_dir):
    """A profile of all texts of each declared language, read by id."""
    docs = spread(documents(spark, sf_dir)).withColumnRenamed("lang", "key")
    return pf.build_profiles(docs, ["key"], order="doc_id").select(F.col("key").alias("lang"), "ngram", "cnt", F.col("rank").cast("long").alias("rank"))


_FLAT = ["script", "language_code", "confidence", "resolution", "label"]


def _alternatives(col="alternatives"):
    return F.array_join(F.transform(col, lambda a: F.concat(a["language_code"], F.lit(":"), F.format_string("%.4f", a["score"]))), " ")


def detect(spark, sf_dir):
    """Detection of every document, row by row."""
    return dt.detect(documents(spark, sf_dir), "doc_id").select("doc_id", "script", "language_code", "confidence", "resolution", "label")


def detect_rowlocal(spark, sf_dir):
    """The same as a struct beside the columns that are there."""
    found = dt.with_detection(documents(spark, sf_dir)).select("doc_id", "detection.*")
    return found.select("doc_id", "script", "language_code", "confidence", "resolution", "label")


def detect_alternatives(spark, sf_dir):
    found = dt.detect(documents(spark, sf_dir), "doc_id").select("doc_id", F.posexplode_outer("alternatives").alias("place", "a")).where("place is not null")
    return found.select("doc_id", "a.language_code", "a.score")


def detect_confusion(spark, sf_dir):
    """Which language, or only which script, the texts of each declared language resolve to."""
    docs = dt.with_detection(documents(spark, sf_dir))
    return docs.groupBy("lang", F.col("detection.resolution").alias("resolution"), F.coalesce("detection.language_code", F.lit("und")).alias("detected")).agg(F.count(F.lit(1)).alias("n"))


def _cases(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return docs.select("doc_id", F.col("lang").alias("expected_language"), F.lit("Latn").alias("script"), F.col("source").alias("variety"), F.when(F.col("doc_id") % 2 == 0, "even").alias("alphabet"), F.size(tx.split_words(F.col("text"))).alias("n"), "text").withColumn(
        "word_count", F.when(F.col("n") < 100, 10).when(F.col("n") < 1000, 100).otherwise(1000)
    )


def eval_totals(spark, sf_dir):
    return ev.totals(ev.evaluate(_cases(spark, sf_dir)))


def eval_grouping_sets(spark, sf_dir):
    return ev.breakdown(ev.evaluate(_cases(spark, sf_dir)))


def eval_confusions(spark, sf_dir):
    return ev.confusions(ev.evaluate(_cases(spark, sf_dir)))


def eval_quality_checks(spark, sf_dir):
    """Rows of ``documents`` that break the invariants of a case set."""
    checks = {
        "has_letter": F.col("text").rlike(charsets.java_class("letter")),
        "no_replacement_character": ~F.col("text").contains("�"),
        "latin_share_over_095": tx.script_share(F.col("text"), "Latn") > 0.95,
        "all_words_lexical": tx.text_all_lexical(F.col("text")),
        "chars_match": F.length("text") == F.col("n_chars"),
    }
    return ev.violations(spread(documents(spark, sf_dir)), checks)


#: Shapes of predictions as JSON, dealt out by id; %s is the text's language.
SHAPES = (
    '"%s"', '{"language_code": " %s ", "script": "latin"}', '{"language_code": null, "language": "%s", "alphabet": "Latn"}', '{"language": "und", "alphabet": "Cyrillic", "script_code": "x"}',
    '{"code": "%s", "script_code": "ARAB", "score": 0.5}', '["%s", 0.9]', '"Cyrillic"', '{"script": null, "alphabet": "Latin", "language": "%s"}', '{"score": 1}', '"und"',
)


def parsed_predictions(spark, sf_dir):
    """Language and script of predictions of every shape, read as a variant, and those that are objects as a map too."""
    shape = F.get(F.array(*map(F.lit, SHAPES)), F.pmod("doc_id", F.lit(len(SHAPES))).cast("int"))
    rows = documents(spark, sf_dir).select("doc_id", F.replace(shape, F.lit("%s"), F.col("lang")).alias("json"))
    rows = rows.select("doc_id", F.parse_json("json").alias("v"), F.when(F.startswith("json", F.lit("{")), F.from_json("json", "map<string, string>")).alias("m"))
    (language, script), (map_language, map_script) = ev.parse_prediction(rows, "v"), ev.parse_prediction(rows, "m")
    return rows.select("doc_id", language.alias("language"), script.alias("script"), map_language.alias("map_language"), map_script.alias("map_script"))


def case_checks(spark, sf_dir):
    """What is wrong with the case windows of the documents: buckets short of 5, lines that two cases of a key share, texts that occur twice."""
    cases = window_cases(spark, sf_dir)
    wanted = cases.select("key").distinct().select("key", F.explode(F.array(*map(F.lit, sm.LENGTHS))).alias("word_count"), F.lit(5).cast("long").alias("n"))
    short = ev.bucket_differences(cases, wanted, ["key", "word_count"]).agg(F.count(F.lit(1)).alias("n"))
    shared = ev.overlaps(cases, "key", "line_start", "line_end").agg(F.count(F.lit(1)).alias("n"))
    twice = ev.duplicates(cases, "text").agg(F.count(F.lit(1)).alias("n"))
    named = lambda df, name: df.select(F.lit(name).alias("check"), "n")
    return named(short, "buckets").unionByName(named(shared, "overlaps")).unionByName(named(twice, "texts"))


def duplicate_texts(spark, sf_dir):
    return ev.duplicates(documents(spark, sf_dir), "text").select(F.md5(F.col("text").cast("binary")).alias("text_md5"), "n")


def detect_mixed_spans(spark, sf_dir):
    """Spans of every conversation turn, by span algebra."""
    turns = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("key"), "text")
    return mx.mixed_spans(turns, "key").select("key.conv_id", "key.turn", "start", "end", "script", "language_code", "confidence", "resolution")


def detect_mixed_summary(spark, sf_dir):
    """The same turns, one row each: the whole text's language and what its spans hold."""
    turns = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("key"), "text")
    m = mx.with_mixed_summary(turns, "key")
    return m.select("key.conv_id", "key.turn", "primary.language_code", F.size("segments").cast("long").alias("n_spans"), F.array_join("language_codes", " ").alias("languages"), "is_mixed_script", "is_mixed_language", "is_mixed", "has_unresolved_segments")


def clause_boundaries(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("key"), "text")
    return mx.boundaries(turns, "key", "text").select("key.conv_id", "key.turn", F.array_join("cuts", " ").alias("cuts"))


def _letters(spark, sf_dir):
    return cp.char_counts(spread(documents(spark, sf_dir)), "lang", "text")


#: First letters of the alphabets that ``respelled`` deals out; some share a script and part of their letters.
ALPHABETS = (0x61, 0xE0, 0xEA, 0x430, 0x43A, 0x561, 0x565, 0x5D0, 0x628, 0x631, 0x915, 0x995, 0xC15, 0x10D0, 0x30AB, 0x4E00)


def alphabet(start: int, size: int = 26) -> str:
    """The first letters from a code point on, without those that normalisation changes."""
    same = (c for c in map(chr, range(start, start + 400)) if c.isalpha() and unicodedata.normalize("NFKC", c).casefold() == c)
    return "".join(islice(same, size))


def respelled(spark, sf_dir):
    """Documents with a-z written in another alphabet, by id: texts in all eleven scripts (``sample`` names the alphabet)."""
    docs = spread(documents(spark, sf_dir))
    k = F.pmod("doc_id", F.lit(len(ALPHABETS))).cast("int")
    text = F.lower("text")
    for i, start in reversed(list(enumerate(ALPHABETS))):
        other = F.translate(F.lower("text"), LATIN, alphabet(start))
        text = F.when(k == i, other).otherwise(text)
    return docs.select("doc_id", F.format_string("alphabet %02d", k).alias("sample"), text.alias("text"))


LATIN = "abcdefghijklmnopqrstuvwxyz"


def blended(spark, sf_dir):
    """Documents in three alphabets each: the whole text in three parts, so that its script changes on the way."""
    docs = spread(documents(spark, sf_dir)).withColumn("low", F.lower("text"))
    n = F.floor(F.length("text") / 3).cast("int")
    k = F.pmod("doc_id", F.lit(len(ALPHABETS))).cast("int")

    def part(text, shift):
        out = text
        for i, start in enumerate(ALPHABETS):
            out = F.when((k + shift) % len(ALPHABETS) == i, F.translate(text, LATIN, alphabet(start))).otherwise(out)
        return out

    text = F.col("low")
    parts = (F.substring(text, F.lit(1), n), F.substring(text, n + 1, n), F.substring(text, 2 * n + 1, F.length("text")))
    return docs.select("doc_id", F.concat(*(part(t, 5 * j) for j, t in enumerate(parts))).alias("text"))


def script_boundaries(spark, sf_dir):
    """Where the script changes in such texts, and the scripts of the runs."""
    found = blended(spark, sf_dir).select("doc_id", tx.script_runs(F.col("text")).alias("runs"))
    return found.select("doc_id", F.array_join(tx.run_changes(F.col("runs")), " ").alias("cuts"), F.array_join(F.transform("runs", lambda r: r["script"]), " ").alias("scripts"))


#: Letters of the tables' texts and how they are spelled with marks of their own.
MARKED = {c: unicodedata.normalize("NFD", c) for c in "áàâãäåçéèêëíìîïñóòôõöúùûüýÁÀÂÃÄÅÇÉÈÊËÍÌÎÏÑÓÒÔÕÖÚÙÛÜÝ"}


def normalize_composed(spark, sf_dir):
    """Documents spelled with marks of their own, composed again (digests of whole texts), and how many characters that saves."""
    text = F.col("text")
    for c, d in MARKED.items():
        text = F.replace(text, F.lit(c), F.lit(d))
    rows = spread(documents(spark, sf_dir)).select("doc_id", text.alias("spelled")).withColumn("nfc", tx.nfc(F.col("spelled")))
    return rows.select("doc_id", F.sha2(F.col("nfc").cast("binary"), 256).alias("nfc_sha256"), (F.length("spelled") - F.length("nfc")).cast("long").alias("saved"))


def script_letters_respelled(spark, sf_dir):
    """Letters of every script in texts of eleven scripts."""
    counts = respelled(spark, sf_dir).select("doc_id", tx.script_counts(tx.normalise(F.col("text"))).alias("c"))
    return counts.select("doc_id", *(F.col(f"c.{s}").alias(s.lower()) for s in charsets.SCRIPTS))


def scripts_respelled(spark, sf_dir):
    """The dominant script of such texts, and that of their detection."""
    docs = dt.with_detection(respelled(spark, sf_dir))
    found = docs.groupBy("sample", F.col("detection.script").alias("script"), (F.col("detection.resolution") == "none").alias("nothing"))
    return found.agg(F.count(F.lit(1)).alias("n"))


def exclusive_letters(spark, sf_dir):
    return cp.exclusive_letters(cp.char_counts(respelled(spark, sf_dir), "sample", "text")).select("sample", "script", "char", "n")


def script_shares(spark, sf_dir):
    return cp.script_shares(_letters(spark, sf_dir)).select("sample", "script", "n", F.bround("share", 9).alias("share"))


def diagnostic_counts(spark, sf_dir):
    return cp.diagnostic_counts(_letters(spark, sf_dir)).select("kind", "sample", "char", "n")


def top_letters(spark, sf_dir):
    return cp.ranked(_letters(spark, sf_dir), ["sample"], "char", 20).select("sample", "char", "n", F.col("rank").cast("long").alias("rank"))


def top_words(spark, sf_dir):
    return cp.top_words(cp.sample_words(spread(documents(spark, sf_dir)), "lang", "doc_id", "text")).select("sample", "word", "n", F.col("rank").cast("long").alias("rank"))


def top_bigrams(spark, sf_dir):
    return cp.top_bigrams(cp.sample_words(spread(documents(spark, sf_dir)), "lang", "doc_id", "text")).select("sample", "bigram", "n", F.col("rank").cast("long").alias("rank"))


def html_paragraphs(spark, sf_dir):
    pages = spread(table(spark, sf_dir, "pages")).select("page_id", paragraphs(F.col("html")).alias("p"))
    return pages.select("page_id", F.posexplode("p").alias("place", "paragraph"))


def first_n_words(spark, sf_dir):
    return spread(documents(spark, sf_dir)).select("doc_id", tx.first_words(F.col("text"), 1000).alias("words"))


def lexical_words(spark, sf_dir):
    return spread(documents(spark, sf_dir)).select("doc_id", F.size(tx.lexical_words(F.col("text"))).cast("long").alias("n_lexical"), F.size(tx.split_words(F.col("text"))).cast("long").alias("n_words"))


def latin_share(spark, sf_dir):
    return spread(documents(spark, sf_dir)).select("doc_id", F.bround(tx.script_share(F.col("text"), "Latn"), 9).alias("share"))


def text_digests(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


def window_cases(spark, sf_dir):
    """Random windows of 1 to 100 words, for every 250 documents, each of them a line."""
    lines = documents(spark, sf_dir).select(F.format_string("d%06d", F.floor(F.col("doc_id") / 250)).alias("key"), F.col("doc_id").alias("line"), "text")
    return sm.case_ids(sm.window_cases(lines), "doc")


def case_buckets(spark, sf_dir):
    """How many of its five cases each length of each 250 documents has."""
    return window_cases(spark, sf_dir).groupBy("key", "word_count").agg(F.count(F.lit(1)).alias("n"))


#: Letters and digits that stand for the 33 letters of the Uyghur Arabic alphabet.
LATIN_FOR_UYGHUR = LATIN + "0123456"


def uyghur_transliterate(spark, sf_dir):
    """All documents spelled in the Uyghur Arabic alphabet, in its three other alphabets (digests of whole texts)."""
    text = F.translate(F.lower("text"), LATIN_FOR_UYGHUR, "".join(row[0] for row in fixed.UYGHUR))
    rows = spread(documents(spark, sf_dir)).select("doc_id", text.alias("text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select("doc_id", digest(uyghur_latin(F.col("text"))).alias("latin"), digest(uyghur_cyrillic(F.col("text"))).alias("cyrillic"), digest(uyghur_new_script(F.col("text"))).alias("new_script"))


QUERIES = {
    f.__name__: f
    for f in (
        normalize_text, tokenize, token_stats, script_letter_counts, dominant_script, ngram_counts, ngram_top300, cue_scores, distinctive_scores, rank_distance,
        build_profiles, detect, detect_rowlocal, detect_alternatives, detect_confusion, eval_totals, eval_grouping_sets, eval_confusions, eval_quality_checks, duplicate_texts, parsed_predictions, case_checks,
        detect_mixed_spans, detect_mixed_summary, clause_boundaries, script_boundaries, normalize_composed, exclusive_letters, script_letters_respelled, scripts_respelled, script_shares, diagnostic_counts, top_letters, top_words, top_bigrams,
        html_paragraphs, first_n_words, lexical_words, latin_share, text_digests, window_cases, case_buckets, uyghur_transliterate,
    )
}
ORACLE = oracle.statements([(LATIN, alphabet(start)) for start in ALPHABETS], LATIN_FOR_UYGHUR, MARKED, SHAPES)
