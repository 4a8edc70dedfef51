"""N-gram Jaccard join by chosen paths.

Each set walks down a random tree: at a node it goes on with those of its tokens whose hash,
taken with the path so far, is small, about ``1 / similarity`` of them. Similar sets share a path
with constant probability; repeated runs bring that to the target recall.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, free, likely, staged, table
from .decontaminate import row_key
from .textkit import U, chunks, mix, seeds, shingles

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.9999999
#: Levels of the tree. A bucket above BUCKET sets goes down a level; at the last one it is
#: compared in blocks of that size, pair of blocks by pair of blocks. Comparing BUCKET sets that have
#: nothing else in common takes about a second, half a megabyte of sketches, and less if they are alike.
DEPTH = 3
BUCKET = 4096
#: A sketch keeps one byte of the least hash in each of so many ranges of the hash.
BINS = 128
#: Sets and tokens in a block of a family.
FAMILY_SETS, FAMILY_TOKENS = 512, 200_000
_A, _B = U(0x632BE59BD9B4E019), U(0xD1B54A32D192ED03)
_EDGES = np.arange(BINS, dtype=U) << U(64 - int(math.log2(BINS)))


def runs_for(recall: float) -> int:
    """Runs until a pair at the threshold meets with this probability on the first level.

    The number of its shared tokens that a run selects has a mean of one at least, so that a run misses
    it with probability 1 / e at most.
    """
    return math.ceil(-math.log(1 - recall))


def deep_runs(recall: float, similarity: float, depth: int) -> tuple[int, int]:
    """Runs until a pair at the threshold meets with this probability ``depth`` levels down, and the depth.

    The larger set of m tokens selects each with probability p = 1 / (similarity m); of a pair of
    unequal sets at the threshold, at least s = ceil(similarity m) are shared. A path takes no token twice, so
    a level d leaves s - d of them. Depth is less where the least s is. Sizes up to 1,000 are tried; from
    there on the probability is below that of Poisson branching by less than a hundredth, which is allowed for.
    """
    whole, part = _ratio(similarity)
    pairs = [(m, s) for m in range(2, 1001) if (s := -(-whole * m // part)) < m]
    if not pairs:
        return runs_for(recall), 1
    depth = max(1, min(depth, min(s for _, s in pairs)))
    least = 1.0
    for m, s in pairs:
        p, meets = min(1.0, part / (whole * m)), 1.0
        for level in range(depth - 1, -1, -1):
            meets = 1 - (1 - p * meets) ** (s - level)
        least = min(least, meets)
    poisson = 1.0
    for _ in range(depth):
        poisson = 1 - math.exp(-poisson)
    least = min(least, 0.99 * poisson)
    return math.ceil(math.log(1 - recall) / math.log(1 - least)) if least < 1 else 1, depth


def paths(tokens: np.ndarray, run_seeds: np.ndarray, similarity: float):
    """Leaves of one set as rows (level 1, 2, 3), 0 where a path has ended."""
    m = len(tokens)
    limit = min(2**64 - 1, int(2**64 / (similarity * m)))
    limit = U(limit)

    def children(nodes):
        """(parent, token index, hash) of the selected tokens below each node."""
        found = []
        step = max(1, (1 << 21) // m)
        for a in range(0, len(nodes), step):
            h = mix(tokens[None, :] ^ nodes[a : a + step, None])
            p, t = np.nonzero(h <= limit)
            found.append((p + a, t, h[p, t]))
        return [np.concatenate(x) for x in zip(*found, strict=True)]

    run, t1, h1 = children(run_seeds)
    p1 = mix(h1 ^ _A)
    if not len(p1):
        return np.zeros((3, 0), U)
    parent, t2, h2 = children(p1)
    fresh = t2 != t1[parent]
    parent, t2, p2 = parent[fresh], t2[fresh], mix(h2[fresh] ^ _B)
    rows = []
    if len(p2):
        above, t3, h3 = children(p2)
        fresh = (t3 != t2[above]) & (t3 != t1[parent[above]])
        above, p3 = above[fresh], mix(h3[fresh] ^ _A)
        ended = np.setdiff1d(np.arange(len(p2)), above)
        rows += [np.stack([p1[parent[above]], p2[above], p3]), np.stack([p1[parent[ended]], p2[ended], np.zeros(len(ended), U)])]
    ended = np.setdiff1d(np.arange(len(p1)), parent)
    rows.append(np.stack([p1[ended], np.zeros(len(ended), U), np.zeros(len(ended), U)]))
    return np.concatenate(rows, axis=1)


def sketch(tokens: np.ndarray) -> bytes:
    """One-permutation minima, a byte each, 0 where the range is empty."""
    at = np.searchsorted(tokens, _EDGES)
    value = tokens[np.minimum(at, len(tokens) - 1)]
    inside = (at < len(tokens)) & (value >> U(64 - int(math.log2(BINS))) == np.arange(BINS, dtype=U))
    return np.where(inside, mix(value) % U(255) + U(1), U(0)).astype(np.uint8).tobytes()


SUMMARY = "_k1 long, _k2 long, key binary, n int, sketch binary, l1 array<long>, l2 array<long>, l3 array<long>"


def _summaries(words, similarity, runs, first=0):
    def run(batches):
        run_seeds = seeds(runs, 5)[first:]
        for batch in batches:
            key, n, sk, leaves = [], [], [], [[], [], []]
            for _, data, offs in chunks(batch.column("text")):
                for t in shingles(data, offs, words):
                    n.append(len(t))
                    key.append(xxhash.xxh3_128_digest(t.tobytes()))
                    sk.append(sketch(t) if len(t) else b"")
                    found = paths(t, run_seeds, similarity) if len(t) else np.zeros((3, 0), U)
                    for have, x in zip(leaves, found, strict=True):
                        have.append(x.view(np.int64))
            offsets = np.cumsum([0, *(len(x) for x in leaves[0])]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(x) if x else np.zeros(0, np.int64))) for x in leaves]
            rest = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "text"]
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(key, pa.binary()), pa.array(n, pa.int32()), pa.array(sk, pa.binary()), *lists], [*names, "key", "n", "sketch", "l1", "l2", "l3"])

    return run


def _whole_groups(batches, name):
    """Batches cut anew so that rows of equal ``name``, which follow each other, stay together."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if rest is not None and rest.num_rows:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        group = batch.column(name).to_numpy()
        last = int(np.searchsorted(group, group[-1]))
        if last:
            yield batch.slice(0, last)
        rest = batch.slice(last)
    if rest is not None and rest.num_rows:
        yield rest


def _alike(similarity):
    """Spanning edges among the sets of each bucket whose sketches may belong to a similar pair."""

    def run(batches):
        for batch in _whole_groups(batches, "bucket"):
            bucket, sid = batch.column("bucket").to_numpy(), batch.column("sid").to_numpy()
            n = len(bucket)
            sk = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(n, BINS)
            label = np.arange(n)
            shift = 1
            at = np.flatnonzero(bucket[1:] == bucket[:-1]) if n > 1 else np.zeros(0, int)
            while len(at):
                todo = at[label[at] != label[at + shift]]
                for k in range(0, len(todo), 1 << 14):
                    i = todo[k : k + (1 << 14)]
                    x, y = sk[i], sk[i + shift]
                    filled = ((x | y) != 0).sum(axis=1)
                    same = ((x == y) & (x != 0)).sum(axis=1)
                    ok = same >= similarity * filled - 5.5 * np.sqrt(similarity * (1 - similarity) * filled) - 1
                    _union(label, i[ok], i[ok] + shift)
                shift += 1
                at = at[at + shift < n]
                at = at[bucket[at] == bucket[at + shift]]
            far = np.flatnonzero(label != np.arange(n))
            yield pa.RecordBatch.from_arrays([pa.array(sid[far]), pa.array(sid[label[far]])], ["a", "b"])

    return run


def _union(label, i, j):
    """Give both ends of every pair the least label of their trees."""
    while len(i):
        a, b = label[i], label[j]
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        while True:  # to the roots
            up = label[label]
            if (up == label).all():
                break
            label[:] = up
        left = label[i] != label[j]
        i, j = i[left], j[left]


def _tokens(words):
    """The sets of the chosen rows, each once for each pair of blocks that it takes part in."""

    def run(batches):
        for batch in batches:
            root, sid, nb, block, copies = (batch.column(c).to_numpy() for c in ("root", "sid", "nb", "block", "copies"))
            rows, group, cross, sets, held = [], [], [], [], 0

            def out():
                r = np.array(rows, np.int64)
                offsets = np.cumsum([0, *(len(s) for s in sets)]).astype(np.int32)
                return pa.RecordBatch.from_arrays([pa.array(np.array(group, np.int64)), pa.array(sid[r]), pa.array(block[r]), pa.array(cross, pa.bool_()), pa.array(copies[r]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64)))], ["grp", "sid", "block", "cross", "copies", "tokens"])

            for row, data, offs in chunks(batch.column("text")):
                for i, t in enumerate(shingles(data, offs, words), row):
                    b = int(block[i])
                    for c in range(int(nb[i])):
                        pair = f"{int(root[i])}:{min(b, c)}:{max(b, c)}" if nb[i] > 1 else f"{int(root[i])}"
                        group.append(xxhash.xxh3_64_intdigest(pair) - (1 << 63))
                        rows.append(i)
                        cross.append(b != c)
                        sets.append(t)
                        held += 8 * len(t)
                    if held > 4 << 20:
                        yield out()
                        rows, group, cross, sets, held = [], [], [], [], 0
            if rows:
                yield out()

    return run


def _count(similarity):
    """Exact links of every set inside its group, and a spanning forest of them."""
    whole, part = _ratio(similarity)

    def one(sid, block, cross, copies, sets):
        keep = np.unique(sid, return_index=True)[1]
        sid, block, copies, sets = sid[keep], block[keep], copies[keep], [sets[k] for k in keep]
        m = len(sid)
        if m < 2:
            return sid, sid, np.zeros(m, np.int64)
        size = np.array([len(s) for s in sets])
        row = np.repeat(np.arange(m), size)
        value, inverse, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        column = (np.cumsum(often > 1) - 1)[inverse]
        shared = often[inverse] > 1
        row, column = row[shared], column[shared]
        by = np.argsort(column, kind="stable")
        row, column = row[by], column[by]
        common = np.zeros((m, m), np.float32)
        width = max(256, (4 << 20) // m)
        edges = np.searchsorted(column, np.arange(0, int(column[-1]) + 1 + width if len(column) else 0, width))
        for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            x = np.zeros((m, width), np.float32)
            x[row[a:b], column[a:b] - k * width] = 1
            common += x @ x.T
        common = np.rint(common).astype(np.int64)
        linked = part * common >= whole * (size[:, None] + size[None, :] - common)
        np.fill_diagonal(linked, False)
        if cross:  # two blocks count the pairs between them alone, also where one of them is empty
            linked &= block[:, None] != block[None, :]
        label = np.arange(m)
        i, j = np.nonzero(np.triu(linked))
        _union(label, i, j)
        return sid, sid[label], (linked * copies[None, :]).sum(axis=1)

    def run(batches):
        for batch in _whole_groups(batches, "grp"):
            group = batch.column("grp").to_numpy()
            sid, block, copies = (batch.column(c).to_numpy() for c in ("sid", "block", "copies"))
            cross = batch.column("cross").to_numpy(zero_copy_only=False)
            tokens = batch.column("tokens")
            values, at = tokens.values.to_numpy().view(U), tokens.offsets.to_numpy()
            edges = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(group)]
            done = [one(sid[a:b], block[a:b], cross[a], copies[a:b], [values[at[k] : at[k + 1]] for k in range(a, b)]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*done, strict=True)], ["sid", "root", "links"])

    return run


def _ratio(similarity):
    """Integers a, b with a / b the threshold, so that ties are decided exactly."""
    from fractions import Fraction

    f = Fraction(str(similarity))
    return f.numerator, f.denominator


def _buckets(sets: DataFrame, depth: int) -> tuple[DataFrame, DataFrame | None]:
    """``bucket, sid``: sets that share a path, in buckets of BUCKET sets or in pairs of blocks; and
    ``sid`` of the sets of larger buckets on the first level, if there are any and a next level."""
    out, above, hot = None, None, None
    for level in range(1, depth + 1):
        if level == 1:
            now = sets.select("sid", F.explode(F.array_distinct("l1")).alias("bucket"))
        else:
            steps = sets.select("sid", F.explode(F.array_distinct(F.arrays_zip(f"l{level - 1}", f"l{level}"))).alias("p"))
            now = steps.select("sid", F.col(f"p.l{level}").alias("bucket"), F.col(f"p.l{level - 1}").alias("up"))
            # one large bucket at most for each BUCKET rows, so that they are broadcast at any size
            now = now.where("bucket <> 0").join(F.broadcast(above), F.col("up") == F.col("large")).select("sid", "bucket").distinct()
        size = staged(now.groupBy("bucket").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1"), "buckets")
        met = now.join(size, "bucket")
        last = level == depth
        small = met if last else met.where(F.col("sets") <= BUCKET)
        nb = F.ceil(F.col("sets") / BUCKET).cast("int")
        if last:
            mine = F.pmod(F.xxhash64("sid"), nb).cast("int")
            small = small.select("sid", "bucket", nb.alias("nb"), mine.alias("mine"))
            pairs = (
                small.where("nb > 1")
                .select("sid", "bucket", "mine", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other"))
                .select("sid", F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other")).alias("bucket"))
            )
            small = small.where("nb = 1").select("sid", "bucket").unionByName(pairs)
        small = small.select("bucket", "sid")
        out = small if out is None else out.unionByName(small)
        above = size.where(F.col("sets") > BUCKET).select(F.col("bucket").alias("large"))
        if last or above.isEmpty():
            return out, hot
        if level == 1:
            hot = met.where(F.col("sets") > BUCKET).select("sid").distinct()
    return out, hot


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL, depth: int = DEPTH) -> DataFrame:
    """Documents whose sets of word shingles have a Jaccard similarity of ``similarity`` or more.

    Returns ``doc_id, class_id, n_links, n_shingles, _class, _k1, _k2``, a row per input row: the number
    of other rows that it is similar to, and the least id of its connected component of such
    links, its own id if it has none. Words are runs of digits, letters (A-Z lower-cased) and
    characters beyond ASCII; a text of fewer than ``words`` words, but some, has one shingle, all of
    them. Texts without a word, and null, link to nothing. Rows with equal sets are a single set with a number
    of copies throughout, so ties and repeated rows cost nothing and all count as links. Shingles
    are 64-bit hashes. Where all ids of a class are null, so is its class_id.

    Paths that two sets share put them in one bucket; a bucket that is too large is split by
    the next level, and what the last level leaves is compared in pairs of blocks. Paths may end in
    a large bucket, so its sets make further runs, as many as the last level needs for ``recall``. In a bucket sketches
    are compared by brute force, with a margin of over five standard deviations. The components
    of these candidates, families, then have all their pairs counted exactly, in pairs of blocks
    as well, each pair in one place. Pairs are never rows: a task gives a count for each set and
    a spanning forest.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *row_key(F.col(id_col), F.col(text_col)))
    kind = base.schema["doc_id"].dataType.simpleString()
    rows = staged(base.mapInArrow(_summaries(words, similarity, runs_for(recall)), f"doc_id {kind}, {SUMMARY}"), "summaries")
    full = rows.where("n > 0")
    sets = full.groupBy("key").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_k1", "_k2")).alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), *(F.first(f"l{i}").alias(f"l{i}") for i in (1, 2, 3))
    )
    sets = staged(sets.select(F.monotonically_increasing_id().alias("sid"), "*"), "sets")
    runs, (most, depth) = runs_for(recall), deep_runs(recall, similarity, depth)
    buckets, hot = _buckets(sets.select("sid", "l1", "l2", "l3"), depth)
    if hot is not None and most > runs:
        asked = staged(hot.join(sets.select("sid", F.col("rep._k1").alias("_k1"), F.col("rep._k2").alias("_k2")), "sid"), "hot")
        texts = likely(base.select("_k1", "_k2", "text"), asked, "_k1").join(asked.hint("merge"), ["_k1", "_k2"]).select("sid", "text")
        further = texts.mapInArrow(_summaries(words, similarity, most, runs), SUMMARY.replace("_k1 long, _k2 long", "sid long"))
        further = further.groupBy("sid").agg(*(F.first(f"l{i}").alias(f"l{i}") for i in (1, 2, 3)))
        buckets = buckets.unionByName(_buckets(staged(further, "further"), depth)[0])
    met = buckets.join(sets.select("sid", "sketch"), "sid").repartition("bucket").sortWithinPartitions("bucket", "sid")
    family = components(met.mapInArrow(_alike(similarity), "a long, b long")).withColumnRenamed("node", "sid")
    member = staged(family.join(sets.select("sid", "rep", "copies", "n"), "sid"), "members")
    weight = member.groupBy("root").agg(F.greatest(F.ceil(F.sum("n") / FAMILY_TOKENS), F.ceil(F.count(F.lit(1)) / FAMILY_SETS)).cast("int").alias("nb"))
    asked = member.join(weight, "root").select("root", "sid", "copies", "nb", F.pmod(F.xxhash64("sid"), F.col("nb")).cast("int").alias("block"), F.col("rep._k1").alias("_k1"), F.col("rep._k2").alias("_k2"))
    texts = likely(base.select("_k1", "_k2", "text"), member.select(F.col("rep._k1").alias("_k1")), "_k1")
    texts = texts.join(asked.hint("merge"), ["_k1", "_k2"]).select("root", "sid", "nb", "block", "copies", "text")
    tokens = texts.mapInArrow(_tokens(words), "grp long, sid long, block int, cross boolean, copies long, tokens array<long>")
    tokens = tokens.repartition("grp").sortWithinPartitions("grp", "sid")
    counted = staged(tokens.mapInArrow(_count(similarity), "sid long, root long, links long"), "links")
    links = counted.groupBy("sid").agg(F.sum("links").alias("links"))
    comps = components(counted.select(F.col("sid").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "sid")
    least = F.min(F.struct(F.col("rep.last").alias("last"), F.col("rep.doc_id").alias("doc_id")))
    reps = sets.select("sid", "key", F.col("copies"), F.struct(F.col("rep.doc_id").isNull().alias("last"), F.col("rep.doc_id").alias("doc_id")).alias("rep"))
    named = comps.join(reps.select("sid", "rep"), "sid")
    roots = named.groupBy("root").agg(least.alias("class"))
    classes = named.select("sid", "root").join(roots, "root").select("sid", "root", F.col("class.doc_id").alias("class_id"), F.lit(True).alias("in_class"))
    info = staged(
        reps.join(links, "sid", "left").join(classes, "sid", "left").select(
            "key", F.coalesce("root", "sid").alias("_class"), F.when(F.col("in_class"), F.col("class_id")).otherwise(F.col("rep.doc_id")).alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
        ),
        "classes",
    )
    out = ["doc_id", "class_id", "n_links", "n_shingles", "_class", "_k1", "_k2"]
    linked = full.select("doc_id", "key", F.col("n").alias("n_shingles"), "_k1", "_k2").join(info, "key").select(*out)
    bare = rows.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("_class"), "_k1", "_k2")
    return linked.unionByName(bare)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one row of each class, that of the least id; all columns as they were.

    Rows without a word are no duplicates and stay. Of rows equal in id and text one stays.
    """
    found = jaccard_join(docs, id_col, text_col, **how)
    bare = F.col("n_shingles") == 0
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "_k1", "_k2")
    kept = found.where(~bare).groupBy("_class").agg(F.min(first).alias("k")).select("k._k1", "k._k2")
    kept = kept.unionByName(found.where(bare).select("_k1", "_k2")).distinct()
    k1, k2 = row_key(F.col(id_col), F.col(text_col))
    r1, r2 = free(docs, "r1"), free(docs, "r2")
    again = not found.groupBy("_k1", "_k2").count().where("count > 1").isEmpty()
    marked = docs.withColumns({r1: k1, r2: k2})
    kept = kept.select(F.col("_k1").alias(free(marked, "k1")), F.col("_k2").alias(free(marked, "k2")))
    out = marked.join(kept, (F.col(r1) == F.col(kept.columns[0])) & (F.col(r2) == F.col(kept.columns[1])), "left_semi")
    if again:
        out = out.dropDuplicates([r1, r2])
    return out.drop(r1, r2)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents")).drop("_class", "_k1", "_k2")
