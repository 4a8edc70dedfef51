"""Benchmark decontamination by winnowing. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, free, likely, marked, staged, table

#: All but ASCII that is neither a digit nor a lower-case letter. Java finds the ranges that are in the class
#: three to ten times as fast as the same class as a complement.
WORD = r"[0-9a-z\x80-\x{10FFFF}]+"
#: The same words before lower-casing.
ANY_CASE = r"[0-9A-Za-z\x80-\x{10FFFF}]+"
WINDOW = 13
#: Words of a k-gram; a window of 13 words has 13 - K + 1 of them and keeps the least hash.
K = 6
#: The test side is broadcast up to so many bytes, as its rows are counted, else joined by a shuffle.
BROADCAST_BYTES = 64 << 20


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once for all its uses."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _zip(a: Column, b: Column, skip: int, both) -> Column:
    """``both`` of a[i] and b[i + skip], as far as both are there."""
    n = F.greatest(F.least(F.size(a), F.size(b) - skip), F.lit(0))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, skip + 1, n), both)


def gram_hashes(h: Column, k: int) -> Column:
    """A hash of the ``k`` words from each position on, from the words' hashes, by doubling."""
    pair = lambda x, y: F.xxhash64(x, y)

    def step(power: Column, have: int, out, got: int, bits: int) -> Column:
        if bits & 1:
            out, got = (power, have) if out is None else (_zip(out, power, got, pair), got + have)
        bits >>= 1
        if not bits:
            return out
        return let(_zip(power, power, have, pair), lambda wider: step(wider, 2 * have, out, got, bits))

    return step(h, 1, None, 0, k)


def window_minima(g: Column, w: int) -> Column:
    """The least of the ``w`` values from each position on, by doubling."""

    def step(m: Column, have: int) -> Column:
        if have == w:
            return m
        hop = min(have, w - have)
        return let(_zip(m, m, hop, lambda x, y: F.least(x, y)), lambda wider: step(wider, have + hop))

    return step(g, 1)


def minima(words: Column, window: int, k: int) -> Column:
    """The least k-gram hash of every window of so many words, in order: its fingerprint.

    It depends on the words of the window alone, so two texts that share a window share its
    fingerprint, wherever it stands in them. A window of fewer words than ``k`` is one k-gram.
    """
    k = min(k, window)
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return let(hashes, lambda h: let(gram_hashes(h, k), lambda g: window_minima(g, window - k + 1)))


def bounded(small: DataFrame, size: int) -> DataFrame:
    return F.broadcast(small) if size <= BROADCAST_BYTES else small


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, k: int = K) -> DataFrame:
    """Words of every document that stand in an occurrence of a benchmark window.

    Returns ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``, a row per input row.
    Words: runs of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII. A window
    is ``window`` consecutive words of an item; an item of fewer words, but some, is one
    window; an item of none, or null, has none. Null and empty documents have no words, no hit
    and the digest of the empty string. Repeated rows each get their result. Items that
    share an id count once; one without an id marks words and counts in no ``n_items``.

    Fingerprints of all document windows meet those of the items in one join; only documents
    with a shared fingerprint then have their windows of that fingerprint compared word by
    word. An item shorter than a window is winnowed as a window of its own length; there are
    ``window`` lengths at most, and documents are fingerprinted for those that occur.
    """
    items = staged(
        benchmark.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(item_text)).alias("w")).where(F.size("w") > 0).select("*", F.least(F.size("w"), F.lit(window)).alias("len")),
        "items",
    )
    lengths = sorted(r[0] for r in items.select("len").distinct().collect())
    # what is done for each length, as one array
    each = lambda of: F.concat(*(of(n) for n in lengths)) if lengths else F.array()
    starts = F.transform(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1), lambda i: F.array_join(F.slice("w", i, F.col("len")), " "))
    owners = items.select("item", "len", F.explode(F.array_distinct(starts)).alias("win")).distinct()
    owners = staged(owners.select("item", "len", "win", *_window_key(F.col("win"))), "owners")
    windows = staged(owners.select("win", "len", "_w1", "_w2").distinct(), "windows")
    per_length = [items.where(F.col("len") == n).select(F.lit(n).alias("len"), F.explode(F.array_distinct(minima(F.col("w"), n, k))).alias("fp")) for n in lengths]
    prints = per_length[0] if per_length else items.select("len", F.lit(0).cast("long").alias("fp"))
    for more in per_length[1:]:
        prints = prints.unionByName(more)
    prints = staged(prints.distinct(), "fingerprints")
    print_bytes = 48 * prints.count()
    window_bytes = windows.agg(F.coalesce(F.sum(F.octet_length("win") + 64), F.lit(0))).first()[0]

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), *row_key(F.col(id_col), F.col(text_col)))
    seen = rows.select(*KEY, words_of(F.col("_text")).alias("w"))
    fingerprint = lambda n: F.transform(F.array_distinct(minima(F.col("w"), n, k)), lambda m: F.struct(F.lit(n).alias("len"), m.alias("fp")))
    empty = F.array().cast("array<struct<len:int,fp:bigint>>")
    found = (
        seen.select(*KEY, F.explode(each(fingerprint) if lengths else empty).alias("p"))
        .select(*KEY, "p.len", "p.fp")
        .join(bounded(prints, print_bytes), ["len", "fp"], "left_semi")
        .groupBy(*KEY)
        .agg(F.collect_set(F.struct("len", "fp")).alias("fps"))
    )
    # few documents share a fingerprint: the others' texts stay where they are
    found = staged(found, "sharing")
    mine = likely(rows, found.select("_k1"), "_k1").join(found, KEY).select(*KEY, "fps", words_of(F.col("_text")).alias("w"))

    def places(n: int) -> Column:
        """Windows of the length whose fingerprint is shared."""
        mine_of = F.transform(F.filter("fps", lambda p: p["len"] == n), lambda p: p["fp"])
        at = lambda fps, m: F.filter(F.transform(m, lambda fp, i: F.when(F.array_contains(fps, fp), i + 1)), lambda i: i.isNotNull())
        window_at = lambda i: F.struct(i.alias("at"), F.lit(n).alias("len"), F.array_join(F.slice("w", i, n), " ").alias("win"))
        found = let(mine_of, lambda fps: F.when(F.size(fps) > 0, let(minima(F.col("w"), n, k), lambda m: at(fps, m))).otherwise(F.array().cast("array<int>")))
        return F.transform(found, window_at)

    spots = mine.select(*KEY, F.explode(each(places) if lengths else F.array().cast("array<struct<at:int,len:int,win:string>>")).alias("s")).select(*KEY, "s.at", "s.win", "s.len")
    hits = staged(spots.join(bounded(windows, window_bytes), ["win", "len"]).select(*KEY, "at", "len", "_w1", "_w2"), "hits")
    # one span for each position, the longest; the spans of a document are at most its words
    spans = hits.groupBy(*KEY, "at").agg(F.max("len").alias("len")).groupBy(*KEY).agg(covered(F.array_sort(F.collect_list(F.struct("at", "len")))).alias("n_hit"))
    which = hits.select(*KEY, "_w1", "_w2").distinct().join(owners.select("item", "_w1", "_w2"), ["_w1", "_w2"])
    which = which.select(*KEY, "item").distinct().groupBy(*KEY).agg(F.array_sort(F.collect_list("item")).alias("items"))
    n_words = F.regexp_count(F.coalesce(F.col("_text"), F.lit("")), F.lit(ANY_CASE)).cast("long")
    out = rows.select(*KEY, "doc_id", n_words.alias("n_words")).join(spans.join(which, KEY), KEY, "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        *KEY,
    )


def _window_key(window: Column) -> list[Column]:
    """128 bits that stand for a window where its owners are looked up."""
    return [F.xxhash64(window).alias("_w1"), F.xxhash64(F.lit(5), window).alias("_w2")]


def covered(spans: Column) -> Column:
    """Positions that the sorted spans (at, len) cover together."""
    end = lambda s: s["at"] + s["len"] - 1
    return F.aggregate(
        spans,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, s: F.struct(F.greatest(a["end"], end(s)).alias("end"), (a["n"] + F.greatest(F.lit(0), end(s) - F.greatest(a["end"], s["at"] - 1))).alias("n")),
        lambda a: a["n"],
    )


#: Rows go by what they hold: rows of equal id and text have equal results.
KEY = ["_k1", "_k2"]


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """128 bits over id and text, the same whenever and wherever a row is read again."""
    null = text.isNull().cast("int")
    return [F.xxhash64(doc_id.cast("string"), null, text).alias("_k1"), F.xxhash64(F.lit(7), null, text, doc_id.cast("string")).alias("_k2")]


def without(docs: DataFrame, bad: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` without the rows whose key is in ``bad``; columns of any name stay as they are.

    Only rows that a bitmap of the keys marks are looked up in ``bad`` and shuffled for it.
    """
    b1, b2, m1, m2, mark = (free(docs, n) for n in ("b1", "b2", "m1", "m2", "mark"))
    k1, k2 = row_key(F.col(id_col), F.col(text_col))
    bad = staged(bad.select(F.col("_k1").alias(m1), F.col("_k2").alias(b2)).distinct(), "bad")
    seen = marked(docs.withColumn(m1, k1).withColumn(m2, k2), bad, m1, mark)
    asked = seen.where(mark).join(bad.withColumnRenamed(m1, b1), (F.col(m1) == F.col(b1)) & (F.col(m2) == F.col(b2)), "left_anti")
    return seen.where(~F.col(mark)).unionByName(asked).drop(m1, m2, mark)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the rows that hold a benchmark window, all columns as they were.

    What is left holds no window at all, however long the document; ``contaminated``, a share of
    the words, is a figure for reports.
    """
    return without(docs, decontaminate(docs, benchmark, id_col, text_col, **how).where("n_hit > 0"), id_col, text_col)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop(*KEY)


OP2_SQL = """
WITH it AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM it WHERE len(w) > 0)),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
spot AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS t
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT a.doc_id, a.i, a.n, w.item_id FROM spot a JOIN win w ON a.n = w.n AND a.t = w.t),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
