"""Ranked lexical search: postings scored in windows of documents, scattered into small arrays."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkit
from .common import LOWER, UPPER, staged, table

TOP = 50
#: Documents of a window: their sums are 32 KB, a bitset of them is 512 bytes.
WINDOW = 4096
#: Terms of the items that one pass over the documents looks for; items with more in all are searched for in several passes.
MAX_TERMS = 1 << 16


def _item_terms(batches):
    """Distinct terms of each item."""
    for batch in batches:
        rows = []
        for _, words, at, _ in textkit.split(batch.column("text"), terms=True):
            listed = words.to_pylist()
            rows += [sorted(set(listed[a:b])) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array(rows, pa.list_(pa.string()))], ["item", "terms"])


def _matches(vocabulary):
    """``n`` terms of each text, and of those looked for their numbers and how often each occurs."""

    def run(batches):
        known = pa.array(vocabulary.value, pa.large_string())
        v = max(1, len(known))
        for batch in batches:
            sizes, ends, terms, times, total = [], [np.zeros(1, np.int64)], [], [], 0
            for _, words, at, _ in textkit.split(batch.column("text"), terms=True):
                found = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                key, tf = np.unique((textkit.owners(at) * v + found)[found >= 0], return_counts=True)
                sizes.append(np.diff(at))
                ends.append(total + np.searchsorted(key, (np.arange(len(at) - 1) + 1) * v))
                terms.append((key % v).astype(np.int32))
                times.append(tf.astype(np.int64))
                total += len(key)
            joined = lambda parts, kind: pa.array(np.concatenate([np.zeros(0, kind), *parts]).astype(kind))
            at = pa.array(np.concatenate(ends).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, joined(terms, np.int32)), pa.ListArray.from_arrays(at, joined(times, np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), joined(sizes, np.int64), *lists], ["doc", "n", "terms", "times"])

    return run


class _Heaps:
    """The best documents of each item so far. Documents come in ascending order, so of equal scores the one that is there stays."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.score = [np.zeros(0, np.int64)] * items
        self.doc = [np.zeros(0, object)] * items
        self.least = np.zeros(items, np.int64)

    def add(self, item: int, score: np.ndarray, doc: np.ndarray) -> None:
        score, doc = np.concatenate([self.score[item], score]), np.concatenate([self.doc[item], doc])
        best = np.argsort(-score, kind="stable")[: self.top]
        self.score[item], self.doc[item] = score[best], doc[best]
        if len(best) == self.top:
            self.least[item] = self.score[item][-1]


def _window(docs: np.ndarray, n: np.ndarray, at: np.ndarray, terms: np.ndarray, times: np.ndarray, weight: np.ndarray, m: np.ndarray, items: list[np.ndarray], heaps: _Heaps) -> None:
    """Score one window of documents for all items, posting list by posting list."""
    slot = np.repeat(np.arange(len(n)), np.diff(at))
    gain = weight[terms] * ((1_000_000_000 * times) // (1000 * times + 20 * m[slot]))
    order = np.argsort(terms, kind="stable")
    slot, gain, terms = slot[order], gain[order], terms[order]
    first = np.flatnonzero(np.diff(terms, prepend=-1))
    ends, there = np.append(first[1:], len(terms)), terms[first]
    sums, bits = np.zeros(len(n), np.int64), {}
    for item, wanted in enumerate(items):
        lists = np.searchsorted(there, wanted)
        lists = lists[there[np.minimum(lists, len(there) - 1)] == wanted] if len(there) else lists[:0]
        if not len(lists):
            continue
        occupied = np.zeros(-(-len(n) // 8), np.uint8)
        for k in lists.tolist():
            here = slot[first[k] : ends[k]]
            sums[here] += gain[first[k] : ends[k]]
            if k not in bits:
                mark = np.zeros(len(n), bool)
                mark[here] = True
                bits[k] = np.packbits(mark)
            occupied |= bits[k]
        touched = np.flatnonzero(np.unpackbits(occupied, count=len(n)))
        score = sums[touched]
        sums[touched] = 0
        better = np.flatnonzero(score > heaps.least[item])
        if len(better) > heaps.top:
            better = np.sort(better[np.argsort(-score[better], kind="stable")[: heaps.top]])
        if len(better):
            heaps.add(item, score[better], docs[touched[better]])


def _ranked(shared, window: int, top: int, kind: pa.DataType):
    """The ``top`` documents of each item among a task's, which come sorted by id."""

    def run(batches):
        items, weight, documents, words = shared.value
        items, weight = [np.array(x, np.int64) for x in items], np.array(weight, np.int64)
        heaps, waiting, n_waiting = _Heaps(len(items), top), [], 0

        def work(limit: int) -> int:
            rows = pa.Table.from_batches(waiting).combine_chunks()
            waiting.clear()
            a = 0
            while len(rows) - a >= limit and a < len(rows):
                part = rows.slice(a, window).combine_chunks().to_batches()[0]
                docs = np.empty(len(part), object)
                docs[:] = part.column(0).to_pylist()
                n, lists = part.column(1).to_numpy(), part.column(2)
                at = lists.offsets.to_numpy().astype(np.int64)
                flat = [c.values.slice(at[0], at[-1] - at[0]).to_numpy().astype(np.int64) for c in (lists, part.column(3))]
                _window(docs, n, at - at[0], *flat, weight, 50 + (50 * n * documents) // max(1, words), items, heaps)
                a += window
            if a < len(rows):
                waiting.extend(rows.slice(a).to_batches())
            return max(0, len(rows) - a)

        for batch in batches:
            waiting.append(batch)
            n_waiting += len(batch)
            if n_waiting >= window:
                n_waiting = work(window)
        if n_waiting:
            work(1)
        for a in range(0, len(items), 1000):
            some = range(a, min(a + 1000, len(items)))
            item = np.repeat(np.array(some, np.int32), [len(heaps.score[k]) for k in some])
            yield pa.RecordBatch.from_arrays(
                [pa.array(item), pa.array([d for k in some for d in heaps.doc[k]], kind), pa.array(np.concatenate([heaps.score[k] for k in some]))], ["item", "doc", "score"]
            )

    return run


def _search(docs: DataFrame, chosen: DataFrame, top: int, window: int) -> DataFrame:
    """``item, rank, doc, score`` for the items of one pass, which fit in memory."""
    spark = docs.sparkSession
    rows = chosen.orderBy("item").collect()
    vocabulary = sorted({t for r in rows for t in r["terms"]})
    number = {t: k for k, t in enumerate(vocabulary)}
    index = staged(docs.mapInArrow(_matches(spark.sparkContext.broadcast(vocabulary)), f"doc {docs.schema['doc'].dataType.simpleString()}, n long, terms array<int>, times array<long>"), "postings")
    documents, words = index.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for r in index.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        df[r["t"]] = r["count"]
    weight = [math.floor(1000 * math.log((2 * documents + 2) / (2 * int(x) + 1))) for x in df]
    # a posting list without weight moves no score
    items = [[number[t] for t in r["terms"] if weight[number[t]] > 0] for r in rows]
    shared = spark.sparkContext.broadcast((items, weight, documents, words))
    kind = pa.schema(index.select("doc").limit(0).toArrow().schema).field(0).type
    scored = index.where(F.size("terms") > 0).sortWithinPartitions(F.col("doc").asc_nulls_last()).mapInArrow(_ranked(shared, window, top, kind), f"item int, doc {index.schema['doc'].dataType.simpleString()}, score long")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc").asc_nulls_last()))
    best = scored.withColumn("rank", place).where(F.col("rank") <= top)
    ids = spark.createDataFrame([(k, r["item"]) for k, r in enumerate(rows)], "item int, number long")
    return best.join(F.broadcast(ids), "item").select("number", "rank", "doc", "score")


def ranked_search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", top: int = TOP, window: int = WINDOW, max_terms: int = MAX_TERMS) -> DataFrame:
    """The ``top`` documents of each item: ``item_id, rank, doc_id, score``, scores above 0 only.

    Terms are runs of ASCII letters (A-Z lower-cased), digits and all beyond ASCII; weights and scores are whole numbers as
    the module's SQL has them. Texts are cut into terms once; what an item asks for is kept as postings of a document,
    a staged table. Each task sorts its documents by id and goes through them in windows of ``window``: a term's
    postings are added into an array of the window's sums, a bitset tells which documents any list has touched, and those above
    the item's worst kept score go to its heap. Only heaps are shuffled. Items with more than ``max_terms`` terms in all are
    searched in passes of about half as many, so what is broadcast and held at the driver has that bound (or one item's terms).

    A row is a document, and a row of items is an item, repeated rows and ids included; equal scores stand by ascending id,
    null ids last. Null and empty texts have no terms: they count in nothing. Empty tables give no rows; other columns are not looked at.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("item"))
    asked = staged(asked, "items")
    terms = staged(asked.select("item", "text").mapInArrow(_item_terms, "item long, terms array<string>").where(F.size("terms") > 0), "item_terms")
    total = terms.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    passes = 1 if total <= max_terms else -(-2 * total // max_terms)
    base = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    found = None
    for k in range(passes):
        some = _search(base, terms.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == k), top, window)
        found = some if found is None else found.unionByName(some)
    names = asked.select(F.col("item").alias("number"), "item_id")
    return found.join(names, "number").select("item_id", F.col("rank").cast("int").alias("rank"), F.col("doc").alias("doc_id"), "score")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
i AS (
  SELECT row_number() OVER () AS k, item_id, list_distinct(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS ts FROM benchmark),
whole AS (SELECT count(*) AS n_docs, sum(len(ts))::BIGINT AS n_all FROM d WHERE len(ts) > 0),
sized AS (SELECT r, doc_id, 50 + (50 * len(ts) * n_docs) // n_all AS m FROM d, whole WHERE len(ts) > 0),
postings AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) GROUP BY r, t),
weights AS (SELECT t, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM postings, whole GROUP BY t),
scored AS (
  SELECT k, r, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM (SELECT k, unnest(ts) AS t FROM i) JOIN weights USING (t) JOIN postings USING (t) JOIN sized USING (r) GROUP BY k, r)
SELECT item_id, rank, doc_id, score FROM (
  SELECT k, doc_id, score, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored JOIN sized USING (r) WHERE score > 0)
JOIN i USING (k) WHERE rank <= 50
"""
