"""Periodic runs of words: lags counted by FFT for frequent words and by differences for rare ones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit
from .common import free, table

#: A run holds this many words at least, and this many periods.
SHORTEST, PERIODS = 24, 3
#: Differences of places made at a time.
BLOCK = 1 << 21
#: What a word is, as a pattern of the JVM.
SPACES = "[\\x20\\x09-\\x0D]+"


def _needed(lag: np.ndarray, shortest: int, periods: int) -> np.ndarray:
    """Successive matches at a lag that the shortest run of that period has."""
    return np.maximum(shortest, periods * lag) - lag


def lag_counts(code: np.ndarray, most: int) -> np.ndarray:
    """How many places have an equal word ``lag`` places on, for lags 0 to ``most`` (0 at lag 0); exact.

    A word is heavy if the differences of its places are more than a transform's work. Heavy words' places are
    correlated by FFT, whose results are whole numbers below the text's length and rounded to them;
    the places of light words are subtracted from each other, one step of their order at a time.
    """
    n = len(code)
    out = np.zeros(most + 1, np.int64)
    if most < 1:
        return out
    order = np.argsort(code, kind="stable")
    first = np.flatnonzero(np.diff(code[order], prepend=-1))
    many = np.diff(np.append(first, n))
    size = 1 << int(n + most).bit_length()
    heavy = np.flatnonzero(many.astype(float) ** 2 > 8.0 * size * max(1, size.bit_length()))
    if len(heavy):
        power = np.zeros(size // 2 + 1)
        for k in heavy.tolist():
            here = np.zeros(size)
            here[order[first[k] : first[k] + many[k]]] = 1.0
            wave = np.fft.rfft(here)
            power += wave.real**2 + wave.imag**2
        out += np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)
    light = np.ones(len(first), bool)
    light[heavy] = False
    group = np.repeat(np.arange(len(first)), many)
    place, many = order[light[group]], many[light]
    ends = np.repeat(np.cumsum(many), many)
    # places ``step`` apart in the order of their word; where the gap is beyond ``most`` it is so for all further steps
    left, step = ends - np.arange(len(place)), 1
    alive = np.flatnonzero(left > step)
    while len(alive):
        still = []
        for a in range(0, len(alive), BLOCK):
            at = alive[a : a + BLOCK]
            gap = place[at + step] - place[at]
            near = gap <= most
            out += np.bincount(gap[near], minlength=most + 1)
            still.append(at[near & (left[at] > step + 1)])
        alive = np.concatenate(still)
        step += 1
    out[0] = 0
    return out


def _islands(code: np.ndarray, lag: int, need: int) -> list[tuple[int, int]]:
    """Maximal stretches of ``need`` and more successive places equal to those ``lag`` on: (first, end).

    A stretch that long covers successive probes a quarter of ``need`` apart, so only the surroundings of such probes are
    compared word by word.
    """
    n = len(code) - lag
    step = max(1, need // 8)
    if step == 1:
        spans = [(0, n)]
    else:
        at = np.arange(0, n, step)
        hit = code[at] == code[at + lag]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
        spans = [(max(0, a * step - step), min(n, b * step)) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if b - a >= need // step - 1]
    out = []
    for a, b in spans:
        edge = np.flatnonzero(np.diff(np.concatenate(([False], code[a:b] == code[a + lag : b + lag], [False])).astype(np.int8)))
        out += [(a + x, a + y) for x, y in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if y - x >= need]
    return out


def runs_of(code: np.ndarray, shortest: int = SHORTEST, periods: int = PERIODS) -> list[tuple[int, int, int]]:
    """All runs of a text as (start, length, period), by start and then period.

    Lags come in ascending order, so a run is met at its smallest period first. What a run of period d matches at a multiple
    of d is taken off that lag's count: those matches belong to no run whose smallest period is the
    multiple, since such a run, holding a whole period of the other, would have the period d as well.
    """
    n = len(code)
    most = n // periods
    if n < shortest or most < 1:
        return []
    left = lag_counts(code, most)
    need = _needed(np.arange(most + 1), shortest, periods)
    found, seen = [], set()
    for lag in np.flatnonzero(left[1:] >= need[1:]) + 1:
        lag = int(lag)
        if left[lag] < need[lag]:
            continue
        for a, b in _islands(code, lag, int(need[lag])):
            if (a, b + lag) in seen:
                continue
            seen.add((a, b + lag))
            found.append((a, b + lag - a, lag))
            further = np.arange(2 * lag, min(most, b + lag - a - 1) + 1, lag)
            left[further] -= b + lag - a - further
    return sorted((a, length, lag) for a, length, lag in found)


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay: those that no run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for a, length, period in runs:
        edge[a + period] += 1
        edge[a + length] -= 1
    return np.cumsum(edge[:n]) == 0


_FOUND = "runs array<struct<start: bigint, length: bigint, period: bigint>>, n_words bigint, collapsed string"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _scan(name: str, found: list[str], shortest: int, periods: int):
    def run(batches):
        for batch in batches:
            column = batch.column(name)
            runs, sizes, texts = [], [], []
            for _, words, at, _ in textkit.split(column):
                code = textkit.codes(words)
                stays = np.ones(len(words), bool)
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    mine = runs_of(code[a:b], shortest, periods)
                    runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in mine])
                    sizes.append(b - a)
                    if mine:
                        stays[a:b] = kept_words(b - a, mine)
                place = np.concatenate([[0], np.cumsum(stays)])[at]
                rest = pa.LargeListArray.from_arrays(pa.array(place, pa.int64()), words.filter(pa.array(stays)).cast(pa.large_string()))
                texts.append(textkit.pc.binary_join(rest, pa.scalar(" ", pa.large_string())).cast(pa.string()))
            joined = pa.chunked_array(texts, pa.string()).combine_chunks() if texts else pa.array([], pa.string())
            made = dict(zip(found, (pa.array(runs, _RUNS), pa.array(sizes, pa.int64()), joined), strict=True))
            names = [c for c in batch.schema.names if c != name]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *made.values()], [*names, *made])

    return run


def periodic_runs(docs: DataFrame, text_col: str = "text", shortest: int = SHORTEST, periods: int = PERIODS) -> DataFrame:
    """``docs`` without the text, and ``runs``, ``n_words`` and ``collapsed``: a row per input row, no shuffle.

    Words are runs of other than ASCII white space, numbered from 0. A run is a stretch with smallest period q (words q
    apart are equal) of at least ``shortest`` words and ``periods`` periods that neither neighbour extends; ``runs`` has
    all of them by start and then period, and ``collapsed`` the words that no run holds after its first q, joined by
    one space. A null or empty text has no words, no runs and an empty ``collapsed``; repeated rows repeat their results; an
    empty table gives no rows; columns of the result that ``docs`` has too (whatever their case) replace those of ``docs``.
    """
    assert periods >= 2, "a stretch of fewer than two periods is no run"
    named = ["runs", "n_words", "collapsed"]
    text = free(docs, "text")
    rest = [c for c in docs.columns if c.lower() not in {*named, text_col.lower()}]
    base = docs.select(*(F.col(f"`{c}`") for c in rest), F.col(text_col).alias(text))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.select(*(f"`{c}`" for c in rest)).schema)
    return base.mapInArrow(_scan(text, named, shortest, periods), f"{schema}, {_FOUND}" if schema else _FOUND)


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` as the query wants them: in a tenth of the documents, by the checksum of the id, the words from a
    place on repeat with a period; both follow from the checksum. Without an id the text stays."""
    words = F.filter(F.split("text", SPACES), lambda w: w != "")
    chosen = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    chosen = chosen.withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("words"))
    g, n = F.floor(F.col("h") / 10), F.col("n")
    chosen = chosen.withColumn("a", F.when(n > 0, g % n).cast("int"))
    left = n - F.col("a")
    chosen = chosen.withColumn("p", (1 + F.floor(left / (3 + g % 8))).cast("int"))
    again = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(left / F.col("p")).cast("int")))
    made = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(again, F.lit(1), left)), " ")
    return chosen.select("doc_id", F.when(n > 0, made).otherwise(F.col("text")).alias("text"))


def greatest(runs: Column) -> Column:
    """The run of greatest length by period, compared without rounding; of equals the first."""
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    return F.reduce(runs, none, lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = periodic_runs(planted(docs)).withColumn("top", greatest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"top.{c}").alias(c) for c in ("start", "length", "period")),
        F.floor(1000 * F.col("top.length") / F.col("top.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


#: The checksum is written out bit by bit; pairs of equal words a lag apart, then gaps and islands.
OP11_SQL = r"""
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
summed AS (
  SELECT *, len(ws) AS n,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: unicode(c)::BIGINT)),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) AS h
  FROM split),
sized AS (SELECT *, CASE WHEN n > 0 THEN (h // 10) % n END AS a FROM summed),
spaced AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM sized),
texts AS (
  SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN ws[i + 1] ELSE ws[a + (i - a) % p + 1] END) ELSE ws END AS ws
  FROM spaced),
words AS (SELECT r, n, unnest(ws) AS w, unnest(range(n)) AS i FROM texts),
pairs AS MATERIALIZED (SELECT x.r, y.i - x.i AS lag, x.i FROM words x JOIN words y ON x.r = y.r AND x.w = y.w AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
lags AS (SELECT r, lag FROM pairs GROUP BY r, lag HAVING count(*) >= greatest(24, 3 * lag) - lag),
marked AS (SELECT r, lag, i, i - row_number() OVER (PARTITION BY r, lag ORDER BY i) AS island FROM pairs SEMI JOIN lags USING (r, lag)),
stretches AS (SELECT r, lag, min(i) AS start, count(*) + lag AS length FROM marked GROUP BY r, lag, island HAVING count(*) >= greatest(24, 3 * lag) - lag),
runs AS (SELECT r, start, length, min(lag) AS period FROM stretches GROUP BY r, start, length),
best AS (
  SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed,
    arg_min(struct_pack(start := start, length := length, period := period), (-length::DOUBLE / period, start, period)) AS top
  FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT r, string_agg(w, ' ' ORDER BY i) AS collapsed FROM words ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, top.start AS start, top.length AS length, top.period AS period,
  (1000 * top.length) // top.period AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM texts LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
"""
