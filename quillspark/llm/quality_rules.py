"""Quality by weak supervision: rules vote or abstain, and expectation-maximisation weighs their votes."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit
from .common import free, staged, table

#: Base: texts below SHORTEST words fail, as do those with more than REPEATS of their words in repeated windows of N words.
SHORTEST, REPEATS, N = 10, 0.20, 5
SYMBOLS, ENDS = "#*$%&|<>", ".!?:;\"'”»…)。！？"
#: Iterations at most, the change that ends them, and what is supposed before the first, with so many imaginary votes behind
#: it: a filter rule seldom calls a good text bad, a bad text trips few of the rules, and most texts are good.
ROUNDS, SETTLED, ON_GOOD, ON_BAD, GOOD, BEHIND = 500, 1e-9, 0.95, 0.3, 0.8, 10.0
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended_lines", "n_letters", "n_capitals", "n_exclamations", "n_same_neighbours", "n_distinct_words", "n_odd_words", "n_bare_words")


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(chars.encode())] = 1
    return out


_IS = {"n_symbols": _table(SYMBOLS), "n_exclamations": _table("!"), "n_capitals": _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "n_letters": _table("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")}


#: Last characters of odd words, and what a word that is not bare has.
_ODD, _SOLID = _table(SYMBOLS + "@^_~=+/\\") > 0, (np.arange(256) >= 0x80) | (_IS["n_letters"] > 0) | (_table("0123456789") > 0)


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the values of each text."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[at])


def _first_seen(key: np.ndarray) -> np.ndarray:
    """Whether a value stands in its first place."""
    out = np.zeros(len(key), bool)
    out[np.unique(key, return_index=True)[1]] = True
    return out


def repeated(code: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Whether a word is in a window of ``n`` words that its text has twice or more; windows are numbered, not hashed."""
    many = len(code)
    if many < n:
        return np.zeros(many, bool)
    own = textkit.owners(at)
    whole = own[: many - n + 1] == own[n - 1 :]
    number = own * (code.max() + 1) + code
    number = np.unique(number, return_inverse=True)[1]
    step = number
    for k in range(1, n):
        pair = step[: many - k] * (number.max() + 1) + number[k:]
        step = np.unique(pair, return_inverse=True)[1]
    twice = (np.bincount(step)[step] > 1) & whole
    edge = np.zeros(many + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + n, -1)
    return np.cumsum(edge[:many]) > 0


def _lines(texts: pa.Array, rows: int) -> dict[str, np.ndarray]:
    lists = pc.split_pattern(texts, "\n")
    flat, at = lists.values, lists.offsets.to_numpy().astype(np.int64)
    bare = pc.ascii_trim_whitespace(flat)
    some = np.asarray(pc.binary_length(bare)) > 0
    own = textkit.owners(at)[some]
    kept = flat.filter(pa.array(some))
    code = textkit.codes(kept)
    again = ~_first_seen(own * (code.max(initial=0) + 1) + code)
    last = pc.utf8_slice_codeunits(bare.filter(pa.array(some)), start=-1)
    ended = np.asarray(pc.is_in(last, value_set=pa.array(list(ENDS), pa.large_string())))
    count = lambda which: np.bincount(own[which], minlength=rows)
    return {"n_lines": np.bincount(own, minlength=rows), "n_dup_lines": count(again), "n_ended_lines": count(ended)}


def _count(name: str):
    def run(batches):
        for batch in batches:
            out = {k: [] for k in COUNTS}
            at_row = 0
            column = pc.fill_null(batch.column(name), "")
            for _, words, at, _ in textkit.split(column):
                rows = len(at) - 1
                part = column.slice(at_row, rows).cast(pa.large_string())
                at_row += rows
                data, offs = next(textkit.chunks(part, 1 << 62))[1:]
                code = textkit.codes(words)
                own = textkit.owners(at)
                same = np.zeros(len(code), bool)
                same[1:] = (code[1:] == code[:-1]) & (own[1:] == own[:-1])
                got = {k: _sums(of[data], offs) for k, of in _IS.items()} | _lines(part, rows)
                inside, ends = next(textkit.chunks(words, 1 << 62), (0, data[:0], np.zeros(1, np.int64)))[1:]
                got |= {
                    "n_words": np.diff(at),
                    "n_odd_words": _sums(_ODD[inside[ends[1:] - 1]], at),
                    "n_bare_words": _sums(_sums(_SOLID[inside].astype(np.int64), ends) == 0, at),
                    "word_chars": _sums(np.asarray(pc.utf8_length(words)).astype(np.int64), at),
                    "n_repeat_words": _sums(repeated(code, at, N), at),
                    "n_same_neighbours": _sums(same, at),
                    "n_distinct_words": _sums(_first_seen(own * (code.max(initial=0) + 1) + code), at),
                }
                for k in COUNTS:
                    out[k].append(got[k].astype(np.int64))
            made = [pa.array(np.concatenate([np.zeros(0, np.int64), *out[k]]), pa.int64()) for k in COUNTS]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *COUNTS])

    return run


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with COUNTS of each whole text; columns of ``docs`` so named, in whatever case, are replaced.

    Words are runs of other than ASCII white space, lines what stands between line feeds and has a word. A null text
    has none of anything.
    """
    assert text_col.lower() not in COUNTS, text_col
    rest = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in COUNTS))
    held = free(rest, "text")
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
    out = rest.withColumn(held, F.col(f"`{text_col}`")).mapInArrow(_count(held), f"{kind}, `{held}` string, " + ", ".join(f"{k} long" for k in COUNTS))
    return out.drop(held)


def ratio(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def _vote(value: Column, good: tuple[float, float], bad_below: float, bad_above: float) -> Column:
    return F.when((value < bad_below) | (value > bad_above), -1).when((value >= good[0]) & (value <= good[1]), 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Votes by name: 1 for a good text, -1 for a bad one, 0 for no opinion. Every rule abstains where a text is too short to tell."""
    inf = math.inf
    all_rules = {
        "symbols": (F.col("n_words") >= 5, _vote(ratio("n_symbols", "n_words"), (0, 0.02), -inf, 0.1)),
        "capitals": (F.col("n_letters") >= 20, _vote(ratio("n_capitals", "n_letters"), (0, 0.2), -inf, 0.4)),
        "exclamations": (F.col("n_words") >= 5, _vote(ratio("n_exclamations", "n_words"), (0, 0.05), -inf, 0.2)),
        "windows": (F.col("n_words") >= 20, _vote(ratio("n_repeat_words", "n_words"), (0, 0.02), -inf, REPEATS)),
        "neighbours": (F.col("n_words") >= 10, _vote(ratio("n_same_neighbours", "n_words"), (0, 0.02), -inf, 0.1)),
        "word_length": (F.col("n_words") >= 10, _vote(ratio("word_chars", "n_words"), (3.5, 9), 2.5, 12)),
        "endings": (F.col("n_lines") >= 2, _vote(ratio("n_ended_lines", "n_lines"), (0.5, 1), 0.2, inf)),
        "odd_words": (F.col("n_words") >= 5, _vote(ratio("n_odd_words", "n_words"), (0, 0.05), -inf, 0.2)),
        "bare_words": (F.col("n_words") >= 5, _vote(ratio("n_bare_words", "n_words"), (0, 0.05), -inf, 0.2)),
        "variety": (F.col("n_words").between(50, 2000), _vote(ratio("n_distinct_words", "n_words"), (0.3, 1), 0.15, inf)),
    }
    return {k: F.when(asked, vote).otherwise(0) for k, (asked, vote) in all_rules.items()}


@dataclass(frozen=True)
class Weights:
    """What the estimation has found: the share of good texts, and of each rule the share of right votes on good and on bad texts."""

    good: float
    right_on_good: dict[str, float]
    right_on_bad: dict[str, float]
    rounds: int

    def log_odds(self, votes: dict[str, Column]) -> Column:
        """Logarithm of the odds that a text is good, a sum with a term for each rule; a rule that abstains adds nothing."""
        terms = [F.lit(math.log(self.good / (1 - self.good)))]
        for k, vote in votes.items():
            g, b = self.right_on_good[k], self.right_on_bad[k]
            terms.append(F.when(vote == 1, math.log(g / (1 - b))).when(vote == -1, math.log((1 - g) / b)).otherwise(0.0))
        return reduce(lambda x, y: x + y, terms)


def estimate(votes: np.ndarray, many: np.ndarray, rounds: int = ROUNDS) -> tuple[float, np.ndarray, np.ndarray, int]:
    """Expectation-maximisation over kinds of votes (rows of -1, 0 and 1) and how many texts have each.

    Given what a text is, rules vote independently, and whether they abstain tells nothing. A rule may not be
    likelier to call a text bad because it is good: where the estimate says so its two shares are set so that it tells nothing.
    """
    k = votes.shape[1]
    good, on_good, on_bad = GOOD, np.full(k, ON_GOOD), np.full(k, ON_BAD)
    up, down, total = votes == 1, votes == -1, max(1.0, float(many.sum()))
    done = 0
    for done in range(1, rounds + 1):  # noqa: B007
        odds = math.log(good / (1 - good)) + up @ np.log(on_good / (1 - on_bad)) + down @ np.log((1 - on_good) / on_bad)
        p = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
        w, v = many * p, many * (1 - p)
        g = (w @ up + BEHIND * ON_GOOD) / (w @ up + w @ down + BEHIND)
        b = (v @ down + BEHIND * ON_BAD) / (v @ up + v @ down + BEHIND)
        wrong = g < 1 - b
        share = (many @ up + BEHIND * ON_GOOD) / (many @ up + many @ down + BEHIND)
        g, b = np.where(wrong, share, g), np.where(wrong, 1 - share, b)
        now = (w.sum() + BEHIND * GOOD) / (total + BEHIND)
        change = max(abs(now - good), float(np.abs(g - on_good).max(initial=0)), float(np.abs(b - on_bad).max(initial=0)))
        good, on_good, on_bad = now, g, b
        if change < SETTLED:
            break
    return good, on_good, on_bad, done


def fit(counted: DataFrame, votes: dict[str, Column] | None = None) -> Weights:
    """Weights from all rows of ``counted``, which has COUNTS.

    Texts are counted by kind of votes before anything leaves the executors: at most 3 to the number of rules rows,
    however many texts there are, hold all that the estimation needs. Without rows the weights are those it starts from.
    """
    votes = rules() if votes is None else votes
    assert len(votes) <= 10, "kinds of votes would not be few"
    kinds = counted.select(*(v.cast("byte").alias(k) for k, v in votes.items())).groupBy(*votes).count().orderBy(*votes).collect()
    rows = np.array([[r[k] for k in votes] for r in kinds], np.int64).reshape(len(kinds), len(votes))
    good, g, b, rounds = estimate(rows, np.array([r["count"] for r in kinds], float))
    return Weights(float(good), dict(zip(votes, g.tolist(), strict=True)), dict(zip(votes, b.tolist(), strict=True)), rounds)


def with_quality(counted: DataFrame, weights: Weights, votes: dict[str, Column] | None = None, least: float = 0.5) -> DataFrame:
    """Adds ``base_failed``, ``quality`` (the posterior probability that a text is good) and ``kept``, replacing columns so named."""
    votes = rules() if votes is None else votes
    base = (F.col("n_words") < SHORTEST) | (100 * F.col("n_repeat_words") > int(100 * REPEATS) * F.col("n_words"))
    out = counted.drop(*(c for c in counted.columns if c.lower() in ("base_failed", "quality", "kept")))
    out = out.withColumn("base_failed", base).withColumn("quality", 1 / (1 + F.exp(-weights.log_odds(votes))))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))


def judged(docs: DataFrame, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with COUNTS, ``base_failed``, ``quality`` and ``kept``: a row per input row, no text shuffled.

    The weights are learnt from all texts of ``docs``, without labels. With ``keep_text`` texts are counted once for the
    weights and once for the result; without it, counts are staged and the text goes. Null and empty texts have no
    words, so they fail and are not kept; no rule has an opinion on them. Repeated rows repeat their results and count each
    time; an empty table gives none.
    """
    others = [c for c in docs.columns if c.lower() != text_col.lower()]
    if keep_text:
        only = staged(with_counts(docs.select(F.col(f"`{text_col}`").alias("text"))).drop("text"), "counts")
        return with_quality(with_counts(docs, text_col), fit(only))
    counted = staged(with_counts(docs, text_col).select(*(f"`{c}`" for c in others if c.lower() not in COUNTS), *COUNTS), "counts")
    return with_quality(counted, fit(counted))


def drop_poor(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns that ``docs`` has."""
    held = {c: free(docs, f"c{k}") for k, c in enumerate(docs.columns)}
    plain = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in held.items()))
    found = judged(plain, held[next(c for c in docs.columns if c.lower() == text_col.lower())])
    return found.where("kept").select(*(F.col(n).alias(c) for c, n in held.items()))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(docs, keep_text=False).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    """Counts, votes and the estimation, a row of it for each iteration."""
    n = {k: f"CASE WHEN {asked} THEN CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END ELSE 0 END" for k, asked, bad, good in (
        ("symbols", "n_words >= 5", "n_symbols / n_words > 0.1", "n_symbols / n_words <= 0.02"),
        ("capitals", "n_letters >= 20", "n_capitals / n_letters > 0.4", "n_capitals / n_letters <= 0.2"),
        ("exclamations", "n_words >= 5", "n_exclamations / n_words > 0.2", "n_exclamations / n_words <= 0.05"),
        ("windows", "n_words >= 20", "n_repeat_words / n_words > 0.2", "n_repeat_words / n_words <= 0.02"),
        ("neighbours", "n_words >= 10", "n_same / n_words > 0.1", "n_same / n_words <= 0.02"),
        ("word_length", "n_words >= 10", "word_chars / n_words < 2.5 OR word_chars / n_words > 12", "word_chars / n_words BETWEEN 3.5 AND 9"),
        ("endings", "n_lines >= 2", "n_ended / n_lines < 0.2", "n_ended / n_lines >= 0.5"),
        ("odd_words", "n_words >= 5", "n_odd / n_words > 0.2", "n_odd / n_words <= 0.05"),
        ("bare_words", "n_words >= 5", "n_bare / n_words > 0.2", "n_bare / n_words <= 0.05"),
        ("variety", "n_words BETWEEN 50 AND 2000", "n_distinct / n_words < 0.15", "n_distinct / n_words >= 0.3"),
    )}
    k = range(1, len(n) + 1)
    odds = "ln(good / (1 - good)) + " + " + ".join(f"CASE v[{j}] WHEN 1 THEN ln(g[{j}] / (1 - b[{j}])) WHEN -1 THEN ln((1 - g[{j}]) / b[{j}]) ELSE 0 END" for j in k)
    sums = ", ".join(f"(coalesce(sum(c * p) FILTER (v[{j}] = 1), 0) + 9.5) / (coalesce(sum(c * p) FILTER (v[{j}] <> 0), 0) + 10) AS g{j}, (coalesce(sum(c * (1 - p)) FILTER (v[{j}] = -1), 0) + 3) / (coalesce(sum(c * (1 - p)) FILTER (v[{j}] <> 0), 0) + 10) AS b{j}, (coalesce(sum(c) FILTER (v[{j}] = 1), 0) + 9.5) / (coalesce(sum(c) FILTER (v[{j}] <> 0), 0) + 10) AS s{j}" for j in k)
    lists = ", ".join(f"[{', '.join(f'CASE WHEN g{j} < 1 - b{j} THEN {x}s{j} ELSE {y}{j} END' for j in k)}] AS {y}" for x, y in (("", "g"), ("1 - ", "b")))
    return rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
lines AS (SELECT r, l, i FROM (SELECT r, unnest(string_split(t, chr(10))) AS l, unnest(range(len(string_split(t, chr(10))))) AS i FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
per_line AS (
  SELECT r, count(*) AS n_lines, count(*) FILTER (k > 1) AS n_dup_lines, count(*) FILTER (regexp_matches(l, '[.!?:;"''”»…)。！？][\x20\x09-\x0D]*$')) AS n_ended
  FROM (SELECT *, row_number() OVER (PARTITION BY r, l ORDER BY i) AS k FROM lines) GROUP BY r),
windows AS (SELECT r, unnest(range(1, len(ws) - 3)) AS i, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) AS win FROM d WHERE len(ws) >= 5),
twice AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, win) AS many FROM windows) WHERE many > 1),
inside AS (SELECT r, count(*) AS n_repeat_words FROM (SELECT DISTINCT r, unnest(range(i, i + 5)) AS i FROM twice) GROUP BY r),
counted AS (
  SELECT r, doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_ended, 0) AS n_ended, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS n_letters,
    length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_capitals, length(regexp_replace(t, '[^!]', '', 'g')) AS n_exclamations,
    len(list_filter(range(1, len(ws)), lambda i: ws[i] = ws[i + 1])) AS n_same, len(list_distinct(ws)) AS n_distinct,
    len(list_filter(ws, lambda w: regexp_matches(w, '[#*$%&|<>@^_~=+/\\]$'))) AS n_odd, len(list_filter(ws, lambda w: NOT regexp_matches(w, '[0-9A-Za-z\x{{80}}-\x{{10FFFF}}]'))) AS n_bare
  FROM d LEFT JOIN per_line USING (r) LEFT JOIN inside USING (r)),
votes AS (SELECT *, [{", ".join(n.values())}] AS v FROM counted),
kinds AS MATERIALIZED (SELECT v, count(*) AS c FROM votes GROUP BY v),
em AS (
  SELECT 0 AS i, 0.8::DOUBLE AS good, list_transform(range({len(n)}), lambda x: 0.95::DOUBLE) AS g, list_transform(range({len(n)}), lambda x: 0.3::DOUBLE) AS b
  UNION ALL
  SELECT i + 1, good, {lists} FROM (
    SELECT max(i) AS i, (sum(c * p) + 8) / (sum(c) + 10) AS good, {sums}
    FROM (SELECT i, v, c, 1 / (1 + exp(-({odds}))) AS p FROM kinds, em WHERE i < 150)) WHERE i IS NOT NULL),
last AS (SELECT good, g, b FROM em WHERE i = 150)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 1 / (1 + exp(-({odds}))) >= 0.5 AS kept
FROM (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM votes), last
"""


OP12_SQL = _sql()
