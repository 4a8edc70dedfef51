"""Removal of repeated substrings by two-stage suffix sorting.

A string of ``length`` bytes is known by the least hash among its ``K``-grams, its anchor, so equal
strings have equal anchors at equal offsets. Neighbouring positions with the same anchor
form a piece; pieces meet by anchor, and the suffixes of those that meet are sorted. Where very
many pieces meet, they are halved by what equal strings share beside the anchor, again and again,
until the buckets are small.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged, table
from .textkit import U, chunks, grams, mix, window_min

LENGTH = 100
K = 24
#: Different pieces that one bucket holds; larger ones are split, see ``_split``.
PIECES = 256


def two_stage_sort(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``text`` in the order of their suffixes, right to ``depth`` bytes at least.

    Only suffixes smaller than their successors are sorted by comparison. The others follow
    by a scan of the buckets of first bytes in ascending order: such a suffix comes before
    all others of its bucket, in the order of its successor, which already has its place
    (successors in the same bucket are reached in rounds, one for each byte of the run).
    """
    n = len(text)
    if n < 2:
        return np.arange(n)
    # type of i: by the first byte behind i that differs; the end is below every byte
    change = np.flatnonzero(text[1:] != text[:-1])
    ends = np.append(change, n - 1)
    run = np.searchsorted(ends, np.arange(n))
    after = np.append(text[1:][change] > text[:-1][change], False)
    small = after[run]
    direct = np.flatnonzero(small)
    padded = np.concatenate([text, np.zeros(depth + 8, np.uint8)])
    order = np.zeros(0, np.int64)
    if len(direct):
        # eight bytes as one number; ties are sorted again by the eight behind, and so on
        key = np.ascontiguousarray(sliding_window_view(padded, 8)).view(">u8").ravel().astype(np.uint64)
        rank = key[direct]
        order = np.argsort(rank, kind="stable")
        group = np.zeros(len(direct), np.int64)
        sorted_key = rank[order]
        group[1:] = np.cumsum(sorted_key[1:] != sorted_key[:-1])
        for step in range(8, depth, 8):
            size = np.bincount(group)
            tied = np.flatnonzero(size[group] > 1)
            if not len(tied):
                break
            who = order[tied]
            k = key[np.minimum(direct[who] + step, len(key) - 1)]
            sub = np.lexsort((k, group[tied]))
            order[tied] = who[sub]
            k = k[sub]
            new = np.ones(len(order), bool)
            new[1:] = group[1:] != group[:-1]
            inner = tied[1:][(k[1:] != k[:-1]) & (tied[1:] == tied[:-1] + 1)]
            new[inner] = True
            group = np.cumsum(new) - 1
        order = direct[order]
    place = np.full(n, -1, np.int64)
    count = np.bincount(text, minlength=256)
    start = np.concatenate([[0], np.cumsum(count)])
    # the directly sorted ones fill their buckets from the end
    head = text[order] if len(order) else np.zeros(0, np.uint8)
    n_small = np.bincount(head, minlength=256)
    base = np.concatenate([[0], np.cumsum(n_small)])
    place[order] = start[1:][head] - n_small[head] + (np.arange(len(order)) - base[head])
    large = np.flatnonzero(~small)
    large = large[np.argsort(text[large], kind="stable")]
    n_large = np.bincount(text[large], minlength=256)
    cut = np.concatenate([[0], np.cumsum(n_large)])
    following = np.append(place, -1)
    for c in np.flatnonzero(n_large):
        todo = large[cut[c] : cut[c + 1]]
        at = start[c]
        reach = ends[run[todo]] - todo  # how many equal bytes are ahead
        by_reach = np.argsort(reach, kind="stable")
        todo, reach = todo[by_reach], reach[by_reach]
        edges = np.flatnonzero(np.diff(reach, prepend=-1, append=-1))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            now = todo[a:b]
            now = now[np.argsort(np.where(now + 1 < n, following[np.minimum(now + 1, n)], -1), kind="stable")]
            following[now] = at + np.arange(len(now))
            at += len(now)
    out = np.empty(n, np.int64)
    out[following[:n]] = np.arange(n)
    return out


def common_prefix(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Whether each suffix of ``order`` shares ``depth`` bytes with the one before it."""
    same = np.zeros(len(order), bool)
    view = sliding_window_view(text, depth)
    for a in range(1, len(order), 8192):
        b = min(len(order), a + 8192)
        same[a:b] = (view[order[a:b]] == view[order[a - 1 : b - 1]]).all(axis=1)
    return same


def repeated(pieces: list[bytes], positions: list[int], depth: int) -> list[np.ndarray]:
    """For each piece, in order of appearance, which of its first positions start a string seen before."""
    text = np.frombuffer(b"".join(pieces), np.uint8)
    first = np.cumsum([0, *map(len, pieces)])
    real = np.zeros(len(text), bool)
    for a, n in zip(first, positions, strict=False):
        real[a : a + n] = True
    order = two_stage_sort(text, depth)
    order = order[real[order]]
    group = np.cumsum(~common_prefix(text, order, depth))
    least = np.full(group[-1] + 1 if len(group) else 1, len(text), np.int64)
    np.minimum.at(least, group, order)
    again = np.zeros(len(text), bool)
    again[order] = least[group] != order
    return [again[a : a + n] for a, n in zip(first, positions, strict=False)]


def _pieces(text: np.ndarray, gram: np.ndarray, length: int):
    """(anchor, first position, positions) of the pieces of one text of at least ``length`` bytes.

    The anchor of a string is the first of its least K-grams; a piece ends where that one
    changes, by its value or, in periodic text, by its place alone. So strings of one piece differ.
    """
    m = window_min(gram, length - K + 1)
    left = gram[: len(m) - 1] == m[:-1]
    first = np.flatnonzero(np.append(True, (m[1:] != m[:-1]) | left))
    count = np.diff(np.append(first, len(m)))
    return m[first], first, count


def _each(batches, length):
    """(batch, row, bytes, anchors, starts, counts, sums) of every text that is long enough."""
    for batch in batches:
        for row, data, offs in chunks(batch.column("text")):
            gram = grams(data, K)
            for i, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
                if b - a >= length:
                    yield batch, row + i, data[a:b], *_pieces(data[a:b], gram[a : b - K + 1], length), gram[a : b - K + 1]


def _anchors(length):
    def run(batches):
        for batch in batches:
            out = [x[3] for x in _each([batch], length)]
            a = np.concatenate(out) if out else np.zeros(0, U)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64))], ["anchor"])

    return run


def _occurrences(length):
    """A row for each piece; ``content`` is a hash of its bytes, a sum over its K-grams by place."""

    def run(batches):
        place = mix(np.arange(1, 4096, dtype=U)) | U(1)
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for _, row, _, anchor, first, count, gram in _each([batch], length):
                # every K-th gram and the last one cover the piece
                span = count + (length - K)
                hops = np.arange(0, int(span.max()) + 1, K)
                h = mix(count.astype(U))
                for j, d in enumerate(hops.tolist()):
                    h += np.where(d < span, gram[np.minimum(first + d, len(gram) - 1)] * place[j], U(0))
                h = mix(h + gram[first + span - 1] * place[4094])
                cols[0].append(np.full(len(first), row))
                for c, v in zip(cols[1:], (anchor.view(np.int64), h.view(np.int64), first.astype(np.int32), count.astype(np.int32)), strict=True):
                    c.append(v)
            if cols[0]:
                rows, *rest = map(np.concatenate, cols)
                yield pa.RecordBatch.from_arrays([batch.column("ord").take(pa.array(rows)), *map(pa.array, rest)], ["ord", "anchor", "content", "start", "count"])

    return run


def _cut(length):
    """The bytes of the pieces that a text is asked for."""

    def run(batches):
        for batch in batches:
            texts, asked = batch.column("text"), batch.column("pieces")
            rows, out, held = [], {k: [] for k in ("anchor", "start", "count", "crowded", "piece")}, 0
            for i in range(batch.num_rows):
                data = (texts[i].as_py() or "").encode()
                for p in asked[i].as_py():
                    rows.append(i)
                    for k in ("anchor", "start", "count", "crowded"):
                        out[k].append(p[k])
                    out["piece"].append(data[p["start"] : p["start"] + p["count"] + length - 1])
                    held += length
                if held > 8 << 20 or i == batch.num_rows - 1:
                    if rows:
                        yield pa.RecordBatch.from_arrays(
                            [batch.column("ord").take(pa.array(rows)), pa.array(out["anchor"], pa.int64()), pa.array(out["start"], pa.int32()), pa.array(out["count"], pa.int32()), pa.array(out["crowded"], pa.bool_()), pa.array(out["piece"], pa.binary())],
                            ["ord", "anchor", "start", "count", "crowded", "piece"],
                        )
                    rows, out, held = [], {k: [] for k in out}, 0

    return run


def _sort_buckets(length):
    """Runs of repeated positions, from rows sorted by (anchor, ord, start)."""

    def run(batches):
        rest = None
        for batch in batches:
            whole = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0] if rest is not None else batch
            anchor = whole.column("anchor").to_numpy()
            last = int(np.searchsorted(anchor, anchor[-1]))
            if last:
                yield from _sorted(whole.slice(0, last), anchor[:last], length)
            rest = whole.slice(last)
        if rest is not None and rest.num_rows:
            yield from _sorted(rest, rest.column("anchor").to_numpy(), length)

    return run


def _sorted(rows, anchor, length):
    """Whole buckets, several sorted together: strings of different anchors are never equal."""
    count, piece = rows.column("count").to_pylist(), rows.column("piece").to_pylist()
    edges = [0, *(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1).tolist(), len(anchor)]
    pick, start, size = [], [], []
    begin = rows.column("start").to_pylist()
    a = 0
    for i, b in enumerate(edges[1:], 1):
        if i < len(edges) - 1 and b - a < 1500:
            continue
        for j, again in zip(range(a, b), repeated(piece[a:b], count[a:b], length), strict=True):
            if again.any():
                e = np.flatnonzero(np.diff(again.astype(np.int8), prepend=0, append=0))
                for x, y in zip(e[::2].tolist(), e[1::2].tolist(), strict=True):
                    pick.append(j)
                    start.append(begin[j] + x)
                    size.append(y - x)
        a = b
    yield pa.RecordBatch.from_arrays([rows.column("ord").take(pa.array(pick, pa.int64())), pa.array(start, pa.int32()), pa.array(size, pa.int32())], ["ord", "start", "count"])


def _split(length):
    """Both halves of each piece: the strings with the more, and with the less, in front of the anchor.

    A string of ``length`` bytes has ``lo`` to ``hi`` bytes before its anchor. In the half from ``mid`` on
    all strings hold the ``mid`` bytes before the anchor and those up to ``length - hi`` behind it; in the other
    half, the ``lo`` before it and those up to ``length - mid + 1`` behind. These bytes go into the key, so
    equal strings keep equal keys, and each split nearly halves what a key leaves open: after as many
    as the bits of ``length`` a key holds a single string.
    """

    def run(batches):
        for batch in batches:
            rows, out = [], {k: [] for k in ("anchor", "start", "count", "at", "lo", "hi", "piece")}
            cols = [batch.column(c).to_pylist() for c in out]
            for i, (anchor, start, count, at, lo, hi, piece) in enumerate(zip(*cols, strict=True)):
                if at < 0:
                    at = int(np.argmin(grams(np.frombuffer(piece, np.uint8)[:length], K)))
                mid = (lo + hi + 1) // 2
                cut = min(max(at - mid + 1, 0), count)  # so many strings are in the first half
                for a, b, low, high in ((0, cut, mid, hi), (cut, count, lo, mid - 1)):
                    if a < b:
                        shared = piece[at - low : at + length - high]
                        key = hashlib.blake2b(b"%d %d %d " % (anchor, low, high) + shared, digest_size=8).digest()
                        rows.append(i)
                        for k, v in zip(out, (int.from_bytes(key, "big", signed=True), start + a, b - a, at - a, low, high, piece[a : b + length - 1]), strict=True):
                            out[k].append(v)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("ord").take(pa.array(rows, pa.int64())), *(pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True))], ["ord", *out])

    return run


def _refined(crowd: DataFrame, length: int) -> tuple[DataFrame | None, list[DataFrame]]:
    """(pieces of small buckets, runs that repeat as a whole) of the pieces of crowded anchors.

    Each round splits the pieces, lets equal halves collapse to the first of them (a minimum that is combined
    before the shuffle) and sets aside what is alone with its key or in a small bucket.
    """
    kind = crowd.schema["ord"].dataType.simpleString()
    plain, again = None, []
    now = crowd.select("ord", "anchor", "start", "count", F.lit(-1).alias("at"), F.lit(0).alias("lo"), F.lit(length - K).alias("hi"), "piece")
    for _ in range(length.bit_length() + 1):
        halves = now.mapInArrow(_split(length), f"ord {kind}, anchor long, start int, count int, at int, lo int, hi int, piece binary")
        halves = staged(halves.withColumn("content", F.xxhash64("piece")), "halves")
        first = F.min(F.struct("ord", "start")).alias("first")
        groups = halves.groupBy("anchor", "content").agg(first, F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in ("count", "at", "lo", "hi", "piece")))
        groups = staged(groups, "groups")
        here = F.struct("ord", "start").alias("here")
        copies = halves.select("anchor", "content", here, "count").join(groups.where("n > 1").select("anchor", "content", "first"), ["anchor", "content"])
        again.append(copies.where("here <> first").select("here.ord", "here.start", "count"))
        met = groups.groupBy("anchor").agg(F.count(F.lit(1)).alias("pieces")).where("pieces > 1")
        left = groups.join(met, "anchor").select("first.ord", "anchor", "first.start", "count", "at", "lo", "hi", "piece", "pieces")
        small = left.where(F.col("pieces") <= PIECES).select("ord", "anchor", "start", "count", "piece")
        plain = small if plain is None else plain.unionByName(small)
        now = left.where(F.col("pieces") > PIECES).drop("pieces")
        if now.isEmpty():
            return plain, again
    raise RuntimeError("a key of whole strings holds different ones")


def _emit(length, keep):
    """Per text: bytes, bytes removed, runs removed and what is left."""

    def run(batches):
        for batch in batches:
            out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept")}
            for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
                data = (text.as_py() or "").encode()
                at = spans.values
                n, removed, runs, left = len(data), 0, 0, data
                if at is not None and len(at):
                    d = np.zeros(n + 1, np.int32)
                    start = at.field("start").to_numpy()
                    np.add.at(d, start, 1)
                    np.add.at(d, start + at.field("count").to_numpy() + (length - 1), -1)
                    gone = np.cumsum(d[:n]) > 0
                    removed, runs = int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
                    left = np.frombuffer(data, np.uint8)[~gone].tobytes()
                for k, v in zip(out, (n, removed, runs, left if keep else hashlib.sha256(left).hexdigest()), strict=True):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([batch.column("ord"), *(pa.array(out[k], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")), pa.array(out["kept"], pa.binary() if keep else pa.string())], ["ord", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def repeated_runs(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``ord, start, count``: runs of positions of ``docs`` (ord, text) whose string starts earlier too."""
    kind = docs.schema["ord"].dataType.simpleString()
    texts = docs.select("ord", "text")
    anchors = texts.select("text").mapInArrow(_anchors(length), "anchor long")
    often = staged(anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "anchors")
    pieces = texts.mapInArrow(_occurrences(length), f"ord {kind}, anchor long, content long, start int, count int")
    pieces = staged(pieces.join(often, "anchor"), "pieces")
    # a content that occurs again is repeated as a whole, but for its first place
    here = F.struct("ord", "start").alias("here")
    contents = staged(pieces.groupBy("anchor", "content").agg(F.min(F.struct("ord", "start")).alias("first"), F.first("count").alias("count"), F.count(F.lit(1)).alias("n")), "contents")
    again = pieces.join(contents.where("n > 1").select("anchor", "content", "first"), ["anchor", "content"]).select(here, "first", "count").where("here <> first").select("here.ord", "here.start", "count")
    met = staged(contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("pieces")).where("pieces > 1"), "met")
    crowded = F.col("pieces") > PIECES
    asked = contents.join(met, "anchor").select(F.col("first.ord").alias("ord"), F.struct("anchor", F.col("first.start").alias("start"), "count", crowded.alias("crowded")).alias("p"))
    asked = asked.groupBy("ord").agg(F.collect_list("p").alias("pieces"))  # at most the document's own
    cut = texts.join(asked, "ord").mapInArrow(_cut(length), f"ord {kind}, anchor long, start int, count int, crowded boolean, piece binary")
    copies = [again]
    if not met.where(crowded).isEmpty():
        cut = staged(cut, "cut")
        plain, more = _refined(cut.where("crowded").drop("crowded"), length)
        cut = cut.where("not crowded").drop("crowded").unionByName(plain)
        copies += more
    else:
        cut = cut.drop("crowded")
    runs = cut.repartition("anchor").sortWithinPartitions("anchor", "ord", "start").mapInArrow(_sort_buckets(length), f"ord {kind}, start int, count int")
    runs = staged(runs, "runs")
    for more in copies:
        runs = runs.unionByName(staged(more, "again"))
    return runs


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep_bytes: bool = False) -> DataFrame:
    """Remove every byte that a string of ``length`` bytes, also starting earlier, covers.

    Earlier is in a document of smaller id, or further ahead in the same one; texts are their
    UTF-8 bytes, and matches never cross documents. Strings are judged on the input, not on
    what is left, and overlaps count. Returns a row per document: ``doc_id, n_bytes, n_removed,
    n_spans`` and ``kept_sha256``, or with ``keep_bytes`` the remaining bytes as ``kept`` (they can
    end inside a character). Null is empty; texts below ``length`` bytes are kept. If ids are
    null or repeat, documents of equal id are ordered by a hash of their texts, null ids
    last, and rows equal in both count as one document with equal results.

    Equal pieces collapse to the first of them by a combined minimum, which settles all but
    one of any number of copies; suffixes are sorted for different pieces of an anchor only.
    """
    base = docs.select(F.col(id_col).alias("ord"), F.col(text_col).alias("text"))
    n, ids = base.agg(F.count(F.lit(1)), F.count_distinct("ord")).first()
    plain = n == ids and isinstance(base.schema["ord"].dataType, T.IntegralType)
    if not plain:
        last = F.col("ord").isNull().alias("last")
        base = base.select(F.struct(last, F.col("ord").alias("id"), F.xxhash64("text").alias("h"), F.coalesce(F.hash("text"), F.lit(0)).alias("g")).alias("ord"), "text")
    distinct = base if plain else base.dropDuplicates(["ord"])
    runs = repeated_runs(distinct, length)
    spans = runs.groupBy("ord").agg(F.collect_list(F.struct("start", "count")).alias("spans"))
    kind = base.schema["ord"].dataType.simpleString()
    joined = base.join(spans, "ord", "left").select("ord", "text", F.coalesce("spans", F.array().cast("array<struct<start:int,count:int>>")).alias("spans"))
    out = joined.mapInArrow(_emit(length, keep_bytes), f"ord {kind}, n_bytes long, n_removed long, n_spans long, kept {'binary' if keep_bytes else 'string'}")
    return out.select((F.col("ord") if plain else F.col("ord.id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.col("kept").alias("kept" if keep_bytes else "kept_sha256"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


OP10_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 200)) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 99, 0))) AS i FROM d)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM p) WHERE r > 1),
g AS (SELECT doc_id, i, i > 100 + lag(i) OVER w OR lag(i) OVER w IS NULL AS new FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT doc_id, i, sum(CAST(new AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
run AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM k GROUP BY doc_id, run),
edge AS (SELECT doc_id, a, coalesce(lag(b) OVER w, 0) AS before, b, lead(a) OVER w IS NULL AS final FROM run WINDOW w AS (PARTITION BY doc_id ORDER BY a)),
kept AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans,
         string_agg(substr(h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY a) || max(CASE WHEN final THEN substr(h, CAST(2 * b + 1 AS BIGINT)) ELSE '' END) AS h
  FROM edge JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
