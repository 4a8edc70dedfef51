"""Text functions as columns, all of them in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..resources import fixed
from . import charsets

_DISTINCTIVE = frozenset(c for weights in fixed.DISTINCTIVE.values() for c in weights)
#: Sizes of n-grams.
SIZES = (2, 3, 4)


#: Unicode's algorithms as Spark has them on its class path for collations; functions of strings that a column calls in the JVM.
_COMPOSE, _FOLD_CASE = ("com.ibm.icu.text.Normalizer", "compose"), ("com.ibm.icu.lang.UCharacter", "foldCase")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _composed(text: Column, compatible: bool) -> Column:
    return F.reflect(*map(F.lit, _COMPOSE), F.coalesce(text, F.lit("")), F.lit(compatible))


def _folded(composed: Column) -> Column:
    return F.reflect(*map(F.lit, _FOLD_CASE), composed, F.lit(True))


def nfc(text: Column) -> Column:
    return F.when(text.isNotNull(), _composed(text, False))


def nfkc(text: Column) -> Column:
    return F.when(text.isNotNull(), _composed(text, True))


def normalise(text: Column) -> Column:
    """NFKC, full case folding, and i with a dot above as i."""
    return F.when(text.isNotNull(), F.replace(_folded(_composed(text, True)), F.lit("i\u0307"), F.lit("i")))


def nfc_casefold(text: Column) -> Column:
    return F.when(text.isNotNull(), _folded(_composed(text, False)))


def tokens(norm: Column) -> Column:
    """Words of a normalised text: letters and marks with single inner apostrophes."""
    pattern = lambda c: F.lit(f"({c}+(?:'{c}+)*)")

    def plain(rest: Column) -> Column:
        # what is no letter and no mark is a space, so that a class of three ranges is left
        none = let(kinds(rest), lambda k: F.regexp_replace(k, charsets.java_class("word") + "+", ""))
        return let(none, lambda x: F.call_function("translate", norm, F.concat(F.lit(fixed.APOSTROPHES), x), F.concat(F.lit("'" * len(fixed.APOSTROPHES)), F.repeat(F.lit(" "), F.length(x)))))

    beyond = let(beyond_ascii(norm), lambda rest: F.when(rest != "", F.regexp_extract_all(plain(rest), pattern("[A-Za-z\\x80-\\x{10FFFF}]"), F.lit(1))))
    return F.coalesce(beyond, F.regexp_extract_all(F.replace(norm, F.lit("`"), F.lit("'")), pattern("[A-Za-z]"), F.lit(1)))


def beyond_ascii(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x7F]+", "")


def kinds(text: Column) -> Column:
    """The different characters of a text: what a class of hundreds of ranges is tried on, in place of every character."""
    return F.array_join(F.array_distinct(F.split(text, "")), "")


def class_counts(text: Column, names: Sequence[str]) -> Column:
    """How many characters of each of these classes a text has, an array; null for null."""
    ascii_only = {n: "".join(sorted({chr(c) for a, b in charsets.ranges()[n] if a < 0x80 for c in range(a, min(b, 0x7F) + 1)})) for n in names}
    of = {c: F.length(text) - F.length(F.regexp_replace(text, f"[{c}]+", "")) for c in ascii_only.values() if c}
    plain = {n: of[c] for n, c in ascii_only.items() if c}
    mine = lambda k, n: F.array_join(F.regexp_extract_all(k, F.lit(f"({charsets.java_class(n)})"), F.lit(1)), "")
    held = lambda rest, m: F.when(m == "", 0).otherwise(F.length(rest) - F.length(F.call_function("translate", rest, m, F.lit(""))))
    counted = lambda rest: let(kinds(rest), lambda k: F.transform(F.array(*(mine(k, n) for n in names)), lambda m: held(rest, m)))
    rest = let(beyond_ascii(text), lambda r: F.when(r == "", F.array(*(F.lit(0) for _ in names))).otherwise(counted(r)))
    return F.when(text.isNotNull(), F.zip_with(rest, F.array(*(plain.get(n, F.lit(0)) for n in names)), lambda x, y: x + y))


def ngrams(word: Column) -> Column:
    """n-grams of a padded word, by size and then by place."""
    padded = F.concat(F.lit("^"), word, F.lit("$"))
    n = F.length(padded)
    of = lambda size: F.when(n >= size, F.transform(F.sequence(F.lit(1), n - (size - 1)), lambda i: F.substring(padded, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))
    return F.concat(*(of(size) for size in SIZES))


def raw_script_counts(text: Column) -> Column:
    """``struct`` of letters per script, before kana decide about Han."""
    return let(class_counts(text, charsets.SCRIPTS), lambda n: F.struct(*(F.get(n, F.lit(k)).cast("long").alias(s) for k, s in enumerate(charsets.SCRIPTS))))


def script_counts(text: Column) -> Column:
    """``struct`` of letters per script; with kana, Han letters are Japanese."""
    def fixed_up(raw: Column) -> Column:
        kana = raw["Jpan"] > 0
        han = {
            "Jpan": F.when(kana, raw["Jpan"] + raw["Hani"]).otherwise(F.lit(0).cast("long")),
            "Hani": F.when(kana, F.lit(0).cast("long")).otherwise(raw["Hani"]),
        }
        return F.struct(*(han.get(s, raw[s]).alias(s) for s in charsets.SCRIPTS))

    return let(raw_script_counts(text), fixed_up)


def with_script(frame: DataFrame, norm: str, prefix: str = "") -> DataFrame:
    """Adds ``script, n_script, script_share`` (with ``prefix``): the most frequent script of the letters of a normalised text.

    Of equals a non-Latin one counts, then the first seen; all are null without letters. With kana, Han is Japanese.
    ASCII letters are counted by themselves, and classes of characters are tried on the different ones of what is left.
    """
    rest, counts, most = f"{prefix}rest", f"{prefix}counts", f"{prefix}n_script"
    raw = f"{prefix}letters"
    out = frame.withColumns({rest: beyond_ascii(F.col(norm)), raw: class_counts(F.col(norm), charsets.SCRIPTS)})
    n = {s: F.get(raw, F.lit(k)) for k, s in enumerate(charsets.SCRIPTS)}
    kana = n["Jpan"] > 0
    both = n["Jpan"] + n["Hani"]
    n |= {"Jpan": F.when(kana, both).otherwise(0), "Hani": F.when(kana, 0).otherwise(n["Hani"])}
    out = out.withColumn(counts, F.array(*n.values()))
    out = out.withColumn(most, F.nullif(F.array_max(counts), F.lit(0)))
    first = {s: F.regexp_instr(rest, F.lit(charsets.java_class(s))) for s in charsets.SCRIPTS}
    first["Jpan"] = F.regexp_instr(rest, F.lit(f"[{charsets.java_class('Jpan')}{charsets.java_class('Hani')}]"))
    tied = [F.when(F.get(counts, F.lit(k)) == F.col(most), F.struct(F.lit(s != "Latn").alias("other"), (F.lit(0) if s == "Latn" else -first[s]).alias("first"), F.lit(s).alias("script"))) for k, s in enumerate(charsets.SCRIPTS)]
    # a filter on the script that is pushed down would compute all of this again; none passes a column that looks random
    out = out.withColumn(f"{prefix}script", F.when(F.rand(0) >= 0, F.array_max(F.array(*tied))["script"]))
    total = F.aggregate(counts, F.lit(0), lambda a, x: a + x)
    return out.withColumns({f"{prefix}script_share": F.col(most) / total, most: F.col(most).cast("long")}).drop(rest, raw, counts)


def with_dominant_script(frame: DataFrame, text: str) -> DataFrame:
    """Adds ``norm, chars, script, n_script, script_share``: the normalised text, its distinctive characters with their numbers, and ``with_script``."""
    out = frame.withColumn("norm", normalise(F.col(text)))
    marks = F.regexp_replace("norm", f"[^{''.join(sorted(_DISTINCTIVE))}]+", "")
    out = with_script(out.withColumn("_marks", marks), "norm")
    seen = F.filter(F.array_distinct(F.split("_marks", "")), lambda c: c != "")
    counted = F.transform(seen, lambda c: F.struct(c, (F.length("_marks") - F.length(F.replace(F.col("_marks"), c))).cast("long")))
    return out.withColumn("chars", F.map_from_entries(counted)).drop("_marks")


def script_share(text: Column, script: str) -> Column:
    """Share of a text's letters that are of one script; Japanese is kana and Han; 0 without letters."""
    names = ["letter", *(("Jpan", "Hani") if script == "Jpan" else (script,))]
    n = lambda c, k: F.get(c, F.lit(k))
    share = let(class_counts(text, names), lambda c: sum((n(c, k) for k in range(2, len(names))), n(c, 1)) / F.nullif(n(c, 0), F.lit(0)))
    return F.coalesce(share, F.lit(0.0))


SPACE = r"(?U)\s+"


#: Numbers summed at a time by ``running_sums``.
BLOCK = 256


def running_sums(numbers: Column) -> Column:
    """Sum of the elements of an array of numbers up to each one.

    A fold that appends copies what it has, so it runs in blocks of BLOCK elements, and once over the sums of the blocks.
    """
    zero = F.lit(0).cast("long")
    last = lambda a: F.coalesce(F.get(a, F.size(a) - 1), zero)
    none = F.array().cast("array<bigint>")

    def blocks(a: Column) -> Column:
        to = lambda b: F.sequence(b * BLOCK, F.least(b * BLOCK + (BLOCK - 1), F.size(a) - 1))
        inside = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / BLOCK).cast("int")), lambda b: F.aggregate(to(b), none, lambda x, i: F.array_append(x, last(x) + F.get(a, i))))
        return let(inside, lambda parts: let(
            F.aggregate(parts, F.array(zero), lambda x, p: F.array_append(x, last(x) + last(p))),
            lambda before: F.flatten(F.transform(parts, lambda p, b: F.transform(p, lambda n: n + F.get(before, b)))),
        ))

    return let(numbers, lambda a: F.when(F.size(a) > 0, blocks(a)).otherwise(none))


#: What ends a clause, a line break or a run of these marks with the blanks behind it.
CLAUSE_END = r"(?:\r\n|\r|\n|[.!?;:]+)[\t \f\x0B]*"


def clause_ends(text: Column) -> Column:
    """Ends of clauses in code points: clauses follow each other without a gap, so they are sums of lengths."""
    clauses = F.regexp_extract_all(text, F.lit(f"[^\\r\\n.!?;:]*{CLAUSE_END}"), F.lit(0))
    return F.when(text.isNotNull(), running_sums(F.transform(clauses, lambda c: F.length(c).cast("long"))))


#: Letters of each script are written as one private character each, all else as a space.
_MARK = {s: chr(0xE000 + k) for k, s in enumerate(charsets.SCRIPTS)}


def script_marks(text: Column) -> Column:
    """The text with a mark of its script in place of each letter of a supported one, and spaces in place of the rest; with kana, Han is Japanese."""
    marks = "".join(_MARK.values())

    def marked(chars: Column) -> Column:
        out = F.regexp_replace(chars, f"[{marks}]", " ")
        for s, mark in _MARK.items():
            out = F.regexp_replace(out, charsets.java_class(s), mark)
        return F.regexp_replace(out, f"[^{marks}]", " ")

    beyond = let(kinds(beyond_ascii(text)), lambda k: F.call_function("translate", text, k, marked(k)))
    out = F.regexp_replace(F.regexp_replace(beyond, "[A-Za-z]", _MARK["Latn"]), f"[^{min(marks)}-{max(marks)}]", " ")
    return let(out, lambda t: F.when(F.contains(t, F.lit(_MARK["Jpan"])), F.translate(t, _MARK["Hani"], _MARK["Jpan"])).otherwise(t))


def script_runs(text: Column) -> Column:
    """Maximal runs of one script, ``script, end`` in code points: a run begins with a letter of another script than the one
    before it, the first with the text; none without letters."""
    runs = F.regexp_extract_all(script_marks(text), F.lit("(?:^ *)?(?:" + "|".join(f"{m}[{m} ]*" for m in _MARK.values()) + ")"), F.lit(0))
    names = F.map_from_arrays(F.array(*(F.lit(m) for m in _MARK.values())), F.array(*(F.lit(s) for s in _MARK)))
    script = lambda r: F.element_at(names, F.substring(F.trim(r), F.lit(1), F.lit(1)))
    return let(runs, lambda rs: F.zip_with(F.transform(rs, script), running_sums(F.transform(rs, lambda r: F.length(r).cast("long"))), lambda s, e: F.struct(s.alias("script"), e.alias("end"))))


def script_changes(text: Column) -> Column:
    """Places of letters whose script is not that of the letter before, in code points.

    A text that has no letters beyond those of the Latin script is not looked at any closer.
    """
    other = "".join(charsets.java_class(s) for s in charsets.SCRIPTS if s != "Latn")
    return F.when(kinds(beyond_ascii(text)).rlike(f"[{other}]"), run_changes(script_runs(text))).when(text.isNotNull(), F.array().cast("array<bigint>"))


def run_changes(runs: Column) -> Column:
    """Ends of all ``script_runs`` but the last: where the script changes."""
    return let(F.transform(runs, lambda r: r["end"]), lambda e: F.slice(e, F.lit(1), F.greatest(F.size(e) - 1, F.lit(0))))


def split_words(text: Column) -> Column:
    """Runs of what is not (Unicode) white space."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def first_words(text: Column, n: int) -> Column:
    """The first ``n`` words joined by single spaces."""
    return F.array_join(F.slice(split_words(text), 1, n), " ")


def first_words_laid_out(text: Column, n: int) -> Column:
    """The text up to the end of its ``n``-th word; an error if it has fewer."""
    cut = F.regexp_extract(text, rf"(?U)^\s*\S+(?:\s+\S+){{{n - 1}}}", 0)
    return F.when(text.isNull(), None).when(cut != "", cut).otherwise(F.raise_error(F.concat(F.lit(f"fewer than {n} words: "), F.size(split_words(text)).cast("string"))))


def lexical_words(text: Column) -> Column:
    """Words that hold a letter."""
    return F.filter(split_words(text), lambda w: w.rlike(charsets.java_class("letter")))


def all_lexical(words: Column) -> Column:
    return F.forall(words, lambda w: w.rlike(charsets.java_class("letter")))


def text_all_lexical(text: Column) -> Column:
    """Whether all words of a text hold a letter: one pass that looks for a word without one, and cuts no words."""
    return ~text.rlike(rf"(?U)(?:^|\s)(?:(?!{charsets.java_class('letter')})\S)++(?:\s|\z)")


def ordered_unique(values: Column) -> Column:
    """Values without nulls, first seen first."""
    return F.array_distinct(F.array_compact(values))


def percentage(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, "n/a").otherwise(F.format_string("%.1f%%", 100.0 * part / whole))
