"""Samples for training and cases for evaluation, reproducible by seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import charsets
from ..functions import text as tx
from ..functions.transliterate import uyghur_cyrillic, uyghur_latin, uyghur_new_script
from ..sources.readers import paragraphs

LENGTHS = (1, 2, 3, 5, 10, 20, 50, 100)


def page_samples(pages: DataFrame, label: str, html: str = "html", words: int = 1000) -> DataFrame:
    """``label, text``: the first words of each page's paragraphs, laid out as paragraphs."""
    joined = F.array_join(paragraphs(F.col(html)), "\n\n")
    return pages.select(F.col(label).alias("label"), tx.first_words_laid_out(joined, words).alias("text"))


def line_samples(lines: DataFrame, key: str = "key", words: int = 1000) -> DataFrame:
    """``key, text``: the first words of each key's lines in order, joined by single spaces.

    Only as many lines as can be needed are gathered: those before the running word count reaches the size.
    """
    sized = lines.withColumn("n", F.size(tx.split_words(F.col("text"))))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    needed = sized.withColumn("before", before).where(F.col("before") < words)
    texts = needed.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("l"), F.sum("n").alias("n"))
    text = tx.first_words(F.array_join(F.transform("l", lambda x: x["text"]), " "), words)
    return texts.select(key, F.when(F.col("n") >= words, text).otherwise(F.raise_error(F.concat(F.lit("too few words for "), F.col(key)))).alias("text"))


#: Words of a line that a window may start at.
DRAWS = 4
#: Places of words that meet in one key of a join.
BLOCK = 128


def drawn(*parts: Column | str) -> Column:
    """A number below 2**32 that follows from what it is drawn for, and from nothing else: the same in every engine that has MD5."""
    named = F.concat_ws(":", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, 8), 16, 10).cast("long")


def _placed(lines: DataFrame) -> DataFrame:
    """``_key, _line, _nth, _words, _before``: lines that hold words, numbered from 1, and how many words of the key stand before each."""
    held = lines.withColumn("_words", tx.split_words(F.col("_text"))).where(F.size("_words") > 0)
    order = Window.partitionBy("_key").orderBy("_line")
    before = F.coalesce(F.sum(F.size("_words")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return held.select("_key", "_line", "_words", F.row_number().over(order).alias("_nth"), before.cast("long").alias("_before"))


def _filled(spans: DataFrame, placed: DataFrame) -> DataFrame:
    """``spans`` (_key, _at, _n, ...) with ``_found``, the words from place ``_at`` on, ``_n`` of them if the key has so many.

    Words meet the spans that need them in blocks of places, so a key of any length is no group. A line's words
    of a block travel together, and a span keeps what it needs of them.
    """
    end = F.col("_before") + F.size("_words")

    def part(block):
        place = F.greatest(F.col("_before"), block * BLOCK)
        words = F.slice("_words", (place - F.col("_before") + 1).cast("int"), (F.least(end, (block + 1) * BLOCK) - place).cast("int"))
        return F.struct(block.alias("block"), place.alias("place"), words.alias("words"))

    parts = F.transform(F.sequence(F.floor(F.col("_before") / BLOCK), F.floor((end - 1) / BLOCK)), part)
    words = placed.select("_key", F.explode(parts).alias("_p"), "_nth", "_line").select("_key", F.col("_p.block").alias("_block"), F.col("_p.place").alias("_from"), F.col("_p.words").alias("_part"), "_nth", "_line")
    keyed = spans.withColumn("_span", F.struct(*spans.columns))
    blocks = F.sequence(F.floor(F.col("_at") / BLOCK), F.floor((F.col("_at") + F.col("_n") - 1) / BLOCK))
    asked = keyed.select("_key", "_span", F.explode(blocks).alias("_block"))
    low = F.greatest(F.col("_span._at"), F.col("_from"))
    high = F.least(F.col("_span._at") + F.col("_span._n"), F.col("_from") + F.size("_part"))
    met = asked.join(words, ["_key", "_block"]).where(low < high)
    piece = F.struct(low.alias("place"), "_nth", "_line", F.slice("_part", (low - F.col("_from") + 1).cast("int"), (high - low).cast("int")).alias("words"))
    pieces = met.select("_span", piece.alias("_p")).groupBy("_span").agg(F.sort_array(F.collect_list("_p")).alias("_ps"))
    single = lambda p: F.transform(p["words"], lambda w, i: F.struct((p["place"] + i).alias("_place"), w.alias("_word"), p["_nth"].alias("_nth"), p["_line"].alias("_line")))
    return pieces.select("_span.*", F.flatten(F.transform("_ps", single)).alias("_found")).withColumn("_text", F.array_join(F.transform("_found", lambda w: w["_word"]), " "))


def windows(lines: DataFrame, key: str = "key", seed: str = "cases", lengths=LENGTHS, per_length: int = 5, seed_key: str | None = None, script: str | None = None, least: str | None = None) -> DataFrame:
    """Windows of whole words for each key of ``lines`` (key, line, text): ``key, word_count, number, text, line_start, line_end, places``.

    A window starts in a line of its own, which is drawn for one of the lengths, at a word that is drawn too (up to DRAWS times until
    the window holds what is asked), and runs on into the lines that follow. Every word holds a letter, texts of a key differ, and with ``script`` and ``least`` (columns)
    so great a share of the letters is of the script. Draws follow from ``seed``, ``seed_key`` (the key) and the line's number.
    Of the windows that hold what is asked, those with the least draw are taken; too few are an error. ``line_start`` and
    ``line_end`` count the lines with words from 1, ``places`` are their ``line`` values.
    """
    more = [c for c in (script, least) if c]
    facts = lines.select(F.col(key).alias("_key"), F.col(seed_key or key).cast("string").alias("_seed"), *(F.col(c).alias(f"_{k}") for k, c in zip(("script", "least"), more, strict=False)))
    facts = facts.groupBy("_key").agg(*(F.first(c).alias(c) for c in facts.columns if c != "_key"))
    placed = _placed(lines.select(F.col(key).alias("_key"), F.col("line").alias("_line"), F.col("text").alias("_text")))
    starts = placed.select("_key", "_nth", "_before", F.size("_words").alias("_size")).join(facts, "_key")
    starts = starts.withColumn("_h", drawn(seed, F.col("_seed"), F.col("_nth")))
    turn = F.row_number().over(Window.partitionBy("_key").orderBy("_h", "_nth")) - 1
    starts = starts.withColumn("_n", F.get(F.array(*map(F.lit, lengths)), turn % len(lengths)))
    starts = starts.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1))))
    starts = starts.withColumn("_at", F.col("_before") + drawn(seed, F.col("_seed"), F.col("_nth"), "word", F.col("_j")) % F.col("_size")).drop("_before", "_size", "_seed")
    found = _filled(starts, placed).where((F.size("_found") == F.col("_n")) & tx.all_lexical(F.transform("_found", lambda w: w["_word"])))
    if more:
        shares = F.create_map(*(x for s in charsets.SCRIPTS for x in (F.lit(s), tx.script_share(F.col("_text"), s))))
        found = found.where(F.coalesce(F.col("_least"), F.lit(0.0)) <= F.coalesce(F.when(F.col("_least") > 0, F.element_at(shares, F.col("_script"))), F.lit(0.0)))
    # of the words only what the result names of them goes on to the windows and joins that follow
    first = found.select(
        "_key", "_n", "_h", "_nth", "_j", "_text", F.get("_found", F.lit(0))["_nth"].alias("_start"), F.get("_found", F.col("_n") - 1)["_nth"].alias("_end"),
        F.array_distinct(F.transform("_found", lambda w: w["_line"])).alias("_places"),
    )
    for same in (["_key", "_n", "_text"], ["_key", "_nth"]):  # a text once, and a line once
        first = first.withColumn("_k", F.row_number().over(Window.partitionBy(*same).orderBy("_h", "_nth", "_j"))).where("_k = 1")
    number = F.row_number().over(Window.partitionBy("_key", "_n").orderBy("_h", "_nth"))
    taken = first.withColumn("_number", number).where(F.col("_number") <= per_length)
    wanted = facts.select("_key", F.explode(F.array(*map(F.lit, lengths))).alias("_n")).select("_key", "_n", F.explode(F.sequence(F.lit(1), F.lit(per_length))).alias("_number"))
    missing = F.raise_error(F.concat(F.lit("no further window of "), F.col("_n").cast("string"), F.lit(" words in "), F.col("_key").cast("string")))
    out = wanted.join(taken, ["_key", "_n", "_number"], "left")
    return out.select(
        F.col("_key").alias("key"), F.col("_n").alias("word_count"), F.col("_number").alias("number"), F.coalesce("_text", missing).alias("text"),
        F.col("_start").alias("line_start"), F.col("_end").alias("line_end"), F.col("_places").alias("places"),
    )


def window_cases(lines: DataFrame, key: str = "key", seed: str = "cases", lengths=LENGTHS, per_length: int = 5, script: str | None = None, min_share: float = 0.0) -> DataFrame:
    """Cases of every length for each key: ``windows`` of one script."""
    given = lines.where(F.size(tx.split_words(F.col("text"))) > 0)
    if script:
        given = given.withColumns({"_of": F.lit(script), "_share": F.lit(float(min_share))})
    return windows(given, key, seed, lengths, per_length, script="_of" if script else None, least="_share" if script else None).drop("places")


def held_out_cases(texts: DataFrame, key: str = "key", seed: str = "cases", lengths=LENGTHS, per_length: int = 5, skip: int = 1000, max_gap: int = 0, unique: bool = False) -> DataFrame:
    """Cases behind a text's first ``skip`` words, one after the other in a drawn order, up to ``max_gap`` words between them.

    The rows of a key are one text, in the order of the column ``line`` if there is one. With ``unique`` twice as many are laid out and of equal
    texts the first counts. A text that is too short is an error. Positions are counted from 1 in the whole text.
    """
    line = F.col("line") if "line" in texts.columns else F.lit(0)
    placed = _placed(texts.select(F.col(key).alias("_key"), line.alias("_line"), F.col("text").alias("_text")))
    laid = per_length * (2 if unique else 1)
    pairs = placed.select("_key").distinct().select("_key", F.explode(F.array(*map(F.lit, lengths))).alias("_n"))
    pairs = pairs.select("_key", "_n", F.explode(F.sequence(F.lit(1), F.lit(laid))).alias("_number")).withColumn("_h", drawn(seed, F.col("_key"), F.col("_n"), F.col("_number"), "place"))
    gap = drawn(seed, F.col("_key"), F.col("_n"), F.col("_number"), "gap") % (max_gap + 1)
    order = Window.partitionBy("_key").orderBy("_h", "_n", "_number")
    spans = pairs.withColumn("_gap", gap).withColumn("_at", skip + F.sum(F.col("_gap") + F.col("_n")).over(order) - F.col("_n")).drop("_gap")
    whole = F.coalesce(F.size("_found"), F.lit(0)) == F.col("_n")
    filled = spans.join(_filled(spans, placed).select("_key", "_n", "_number", "_found", "_text"), ["_key", "_n", "_number"], "left")
    out = filled.withColumn("_text", F.when(whole, F.col("_text")).otherwise(F.raise_error(F.concat(F.lit("held-out text is too short: "), F.col("_key").cast("string")))))
    if unique:
        out = out.withColumn("_k", F.row_number().over(Window.partitionBy("_key", "_n", "_text").orderBy("_at"))).where("_k = 1")
        out = out.withColumn("_number", F.row_number().over(Window.partitionBy("_key", "_n").orderBy("_at"))).where(F.col("_number") <= per_length)
    return out.select(F.col("_key").alias("key"), F.col("_n").alias("word_count"), F.col("_number").alias("number"), F.col("_text").alias("text"), (F.col("_at") + 1).cast("int").alias("line_start"), (F.col("_at") + F.col("_n")).cast("int").alias("line_end"))


def case_ids(cases: DataFrame, prefix: str) -> DataFrame:
    """``id`` of cases: prefix, word count and number."""
    return cases.withColumn("id", F.format_string(f"{prefix}-%03dw-%02d", "word_count", "number"))


def uyghur_variants(cases: DataFrame) -> DataFrame:
    """Each case of Uyghur Arabic text in three more alphabets, with ids and texts of their own."""
    text = F.col("text")
    variants = F.array(
        *(
            F.struct(F.lit(tag).alias("variant"), F.lit(script).alias("script"), F.lit(name).alias("alphabet"), convert(text).alias("text"))
            for tag, script, name, convert in (("uly", "Latn", "ULY", uyghur_latin), ("uky", "Cyrl", "UKY", uyghur_cyrillic), ("uyy", "Latn", "UYY", uyghur_new_script))
        )
    )
    rest = [c for c in cases.columns if c not in ("id", "text", "script", "alphabet")]
    out = cases.select("id", *rest, F.explode(variants).alias("v"))
    return out.select(F.concat("id", F.lit("-"), F.col("v.variant")).alias("id"), *rest, "v.script", "v.alphabet", "v.text")


def union_cases(*parts: DataFrame) -> DataFrame:
    """Case sets together, absent fields null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
