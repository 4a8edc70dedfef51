"""Operators on documents against brute force, with the awkward cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from quillspark.llm import common, decontaminate, exact_dedup, jaccard_join, mixing, suffix_dedup

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, w string, key string, _b1 string, _k1 string, _r2 string, _sha string, _key string, copies string"


def words(text):
    return WORD.findall((text or "").translate(AZ))


def frame(spark, rows, parts=3):
    """Rows (id, text[, source]) with further columns whose names clash with inner ones."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None, *"xyzabcdef") for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def corpus(seed=1, n=150):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéÉ") for _ in range(rng.randint(2, 8))) for _ in range(200)]
    some = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    shared = [some(rng.randint(20, 60)) for _ in range(8)]
    rows = []
    for i in range(n):
        text = ". ".join(rng.choice(shared) if rng.random() < 0.3 else some(rng.randint(1, 50)) for _ in range(rng.randint(1, 5)))
        if rows and rng.random() < 0.3:
            text = rng.choice(rows[:20])[1] or ""
            if rng.random() < 0.7:
                text = text.replace(rng.choice(vocabulary), rng.choice(vocabulary)).upper()
        rows.append((rng.randrange(10**6) * 1000 + i, text, f"s{i % 4}" if i % 9 else None))
    rows += [(7, None, "s1"), (8, "", "s1"), (9, "!! ?", "s2"), (10, "Word", None), (11, "word", "s3"), (12, "the " * 500, "s0")]
    rows.append((13, some(4000), "s0"))
    return rows


def test_exact(spark):
    rows = corpus() + [(8, ""), (None, "word"), (None, "lone")]
    got = exact_dedup.exact_duplicates(frame(spark, rows)).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[(r[1] or "").translate(AZ)].append(r[0])
    sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    assert Counter((r.doc_id, r.text_sha256) for r in got) == Counter((i, s) for s, ids in sha.items() for i in ids)
    kept = Counter()
    for r in got:
        ids = sha[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}


def test_exact_heavy_and_drop(spark):
    rows = [(i, "Hot text" if i % 2 else f"text {i}") for i in range(400)] + [(3, "hot TEXT")] * 2
    got = exact_dedup.exact_duplicates(frame(spark, rows), heavy_share=0.1).collect()
    assert sum(r.kept for r in got) == 201 and {r.group_size for r in got} == {1, 202}
    left = exact_dedup.drop_exact_duplicates(frame(spark, rows + [(5000, None), (5000, None)]))
    assert left.count() == 202 and left.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")


def brute_windows(rows, items):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1) if w else ():
            windows[tuple(w[i : i + n])].add(str(item))
    out = []
    for i, text, *_ in rows:
        w = words(text)
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                if (k := tuple(w[a : a + n])) in windows:
                    hit |= set(range(a, a + n))
                    found |= windows[k]
        ids = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(found), ids, bool(hit) and 20 * len(hit) >= len(w)))
    return Counter(out)


@pytest.mark.parametrize("with_short", [False, True])
def test_decontaminate(spark, with_short):
    rows = corpus(2) + [(8, ""), (None, "word"), (12, "the " * 500), (15, "filler " * 600 + "a b c d e f g h i j k l m n")]
    items = [(k, " ".join(words(rows[3 * k][1])[3:30])) for k in range(20)] + [(3, "a b c d e f g h i j k l m n"), (100, " ".join(words(rows[0][1])[:40]))]
    items += [(101, "the " * 20)]
    if with_short:
        items += [(102, "Word"), (103, None), (104, "..."), (105, " ".join(words(rows[1][1])[2:9])), (106, "word")]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items if with_short or len(words(t)) >= 13], "item_id long, text string, w string")
    got = decontaminate.decontaminate(frame(spark, rows), bench).drop("_k1", "_k2")
    assert Counter(map(tuple, got.collect())) == brute_windows(rows, [(r[0], r[1]) for r in bench.collect()])
    # a single window is enough for a document to go
    clean = decontaminate.drop_contaminated(frame(spark, rows), bench)
    want = brute_windows(rows, [(r[0], r[1]) for r in bench.collect()])
    assert clean.count() == sum(v for k, v in want.items() if not k[2]) < len(rows)
    assert any(k[2] and not k[5] for k in want) and clean.columns == frame(spark, rows).columns


def test_decontaminate_short_items_stay_small(spark):
    """Items below a window: one small row for each distinct word, none with the words of the text."""
    text = " ".join(f"w{i}" for i in range(3000))
    bench = spark.createDataFrame([(1, "w5"), (2, "w7 w8 w9"), (3, "w2998 w2999"), (4, "w9 w8")], "item_id long, text string")
    got = decontaminate.decontaminate(frame(spark, [(1, text), (2, "w9 w8 w7")]), bench)
    assert sorted(tuple(r)[:4] for r in got.drop("_k1", "_k2").collect()) == [(1, 3000, 6, 3), (2, 3, 2, 1)]
    plan = got._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_words_of_every_character(spark):
    """Every character is inside of words or between them as the contract's pattern has it."""
    every = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    rows = [(k, "".join(f"a{chr(c)}B " for c in every[k : k + 4096])) for k in range(0, len(every), 4096)]
    got = frame(spark, rows).select("doc_id", decontaminate.words_of(F.col("text")).alias("w"), F.regexp_count("text", F.lit(decontaminate.ANY_CASE)).alias("n")).collect()
    assert {r.doc_id: r.w for r in got} == {i: words(t) for i, t in rows}
    assert all(r.n == len(r.w) for r in got)


def test_empty_tables(spark):
    none, bench = frame(spark, [], 1), spark.createDataFrame([], "item_id long, text string")
    assert exact_dedup.exact_duplicates(none).count() == 0
    assert decontaminate.decontaminate(none, bench).count() == 0
    assert decontaminate.decontaminate(frame(spark, [(1, "a b")]), bench).first().n_words == 2
    assert mixing.mix(none).count() == 0
    assert jaccard_join.jaccard_join(none).count() == 0
    assert suffix_dedup.suffix_dedup(none).count() == 0


def test_mix(spark):
    rows = corpus(3) + [(8, "", "s1"), (20, None, None)]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = Counter()
    for _, t, s in rows:
        by[s] += size(t)
    order = {s: by[s] for s in sorted((s for s in by if s is not None))} | {None: by[None]}
    goal = mixing.targets(order)
    assert abs(sum(goal.values()) - sum(by.values())) < 1e-6 and all(goal[s] <= 3 * by[s] + 1e-9 for s in by)
    got = mixing.mix(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((i, s, size(t)) for i, t, s in rows)
    taken, exact = Counter(), Counter()
    for r in got:
        assert r.source_size == by[r.source] and abs(r.target - goal[r.source]) < 1e-6
        assert r.taken == r.copies * r.size <= 3 * r.size
        taken[r.source] += r.taken
        exact[r.source] += r.rate * r.size
    for s in by:
        assert abs(exact[s] - goal[s]) <= 1e-6 * goal[s]
        assert abs(taken[s] - goal[s]) <= max(60, 0.01 * goal[s]), (s, taken[s], goal[s])
    again = mixing.mix(frame(spark, rows, 5)).collect()
    assert Counter((r.doc_id, r.copies) for r in got) == Counter((r.doc_id, r.copies) for r in again)


def test_mixed_documents(spark):
    rows = corpus(3, 60)
    docs = frame(spark, rows)
    got = mixing.mixed_documents(docs)
    assert got.columns == [c for c in docs.columns if c != "copies"] + ["size", "source_size", "target", "rate", "copies", "taken"]
    out = got.collect()
    assert Counter((r.doc_id, r.text, r.source, r._row) for r in out) == Counter((i, t, s, "x") for i, t, s in rows)
    assert Counter((r.doc_id, r.copies) for r in out) == Counter((r.doc_id, r.copies) for r in mixing.mix(docs).collect())
    assert mixing.repeated_documents(got).count() == sum(r.copies for r in out)


def test_multipliers_far_out(spark):
    """Roots far beyond the first bracket, and an error where there is none within the rounds."""
    hist = spark.createDataFrame([(0, 1.0, 5), (1, 0.001, 10)], "k int, x double, n long")
    state = [{"k": 0, "size": 5, "target": 5 * 1e-40, "scale": 1.0}, {"k": 1, "size": 0.01, "target": 0.0299, "scale": 1.0}]
    lam = mixing.solve_dual(hist, state)
    assert lam[0] == pytest.approx(-92.1034, abs=1e-3) and lam[1] == pytest.approx(1095.273, abs=1e-2)
    with pytest.raises(RuntimeError):
        mixing.solve_dual(hist, state, rounds=2)


def test_targets_limits():
    assert mixing.targets({"a": 10, "b": 1000, None: 100}) == pytest.approx({"a": 30, "b": 780, None: 300})
    assert mixing.targets({"a": 0, "b": 0}) == {"a": 0, "b": 0}


def brute_near(rows):
    sets = []
    for i, text, *_ in rows:
        w = words(text)
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()))
    links, root = [0] * len(sets), list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 5 * len(a & b) >= 4 * len(a | b):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    classes = defaultdict(list)
    for i in range(len(sets)):
        classes[find(i)].append(sets[i][0])
    least = {c: min((i for i in ids if i is not None), default=None) for c, ids in classes.items()}
    return Counter((sets[i][0], least[find(i)], links[i]) for i in range(len(sets)))


@pytest.mark.parametrize("limits", [(1000, 512), (15, 25)])
def test_jaccard(spark, monkeypatch, limits):
    monkeypatch.setattr(jaccard_join, "BUCKET", limits[0])
    monkeypatch.setattr(jaccard_join, "FAMILY_SETS", limits[1])
    rng = random.Random(5)
    base = [f"w{rng.randrange(300)}" for _ in range(120)]
    rows = corpus(4, 100) + [(8, ""), (None, "word"), (None, "other lone words here now"), (12, "the " * 500)]
    for i in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(300)}"
        rows.append((5000 + i, " ".join(w), "s"))
    got = jaccard_join.jaccard_join(frame(spark, rows))
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got.collect()) == brute_near(rows)
    if limits[0] == 1000:
        left = jaccard_join.drop_near_duplicates(frame(spark, rows))
        bare = len({r[:2] for r in rows if not words(r[1])})
        classes = {c for i, c, n in brute_near(rows)} - {r[0] for r in rows if not words(r[1])}
        assert left.count() == len(classes) + bare
        assert left.columns == frame(spark, rows).columns


def test_jaccard_short_texts_in_large_buckets(spark, monkeypatch):
    """Pairs of 4 and 5 shingles that share 4, where every bucket is too large but on the last level."""
    assert jaccard_join.deep_runs(0.9999999, 0.8, 3) == (53, 3) and jaccard_join.deep_runs(0.9999999, 0.5, 3)[1] == 1
    monkeypatch.setattr(jaccard_join, "BUCKET", 1)
    rows = []
    for k in range(2000):
        w = [f"v{k}x{i}" for i in range(9)]
        rows += [(2 * k, " ".join(w), "s"), (2 * k + 1, " ".join(w[:8]), "s")]
    got = jaccard_join.jaccard_join(frame(spark, rows)).collect()
    assert {(r.doc_id, r.class_id, r.n_links) for r in got} == {(i, i // 2 * 2, 1) for i in range(4000)}


def test_jaccard_empty_blocks(spark, monkeypatch):
    """Families of two and three sets in more blocks than some of them fill."""
    monkeypatch.setattr(jaccard_join, "FAMILY_TOKENS", 50)
    rows = []
    for k in range(24):
        base = [f"v{k}x{i}" for i in range(60)]
        rows += [(10 * k + i, " ".join(base + [f"end{i}"]), "s") for i in range(2 + k % 2)]
    got = jaccard_join.jaccard_join(frame(spark, rows))
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got.collect()) == brute_near(rows)


def shuffled(spark):
    """Bytes that the shuffles of the session have written."""
    sc, none = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm.java.util.ArrayList()
    sc.listenerBus().waitUntilEmpty()
    stages = sc.statusStore().stageList(none, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), none)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_likely_rows(spark):
    """No row with a key is lost, of the others few stay; columns and null keys are no trouble."""
    rows = spark.range(-20000, 20000).selectExpr("xxhash64(id) as k", "id as piece", "'x' as bits").repartition(3)
    keys = rows.where("piece % 10 = 0").select("k")
    got = common.likely(rows, keys.unionByName(keys).unionByName(spark.sql("SELECT cast(null AS long) AS k")), "k")
    ids = {r.piece for r in got.collect()}
    assert got.columns == ["k", "piece", "bits"] and {i for i in range(-20000, 20000) if i % 10 == 0} <= ids
    assert len(ids) < 4000 + 36000 / 8
    assert common.likely(rows, keys.where("false"), "k").count() == 0


def test_jaccard_shuffles_few_texts(spark, monkeypatch):
    """Texts outside of families and large buckets stay where they are, and levels are not dealt out for a few buckets."""
    monkeypatch.setattr(jaccard_join, "BUCKET", 40)
    rng = random.Random(8)
    some = lambda k: " ".join(f"{rng.getrandbits(48):x}" for _ in range(k))
    rows = [(i, some(2500), "s") for i in range(300)]
    rows += [(1000 + i, rows[i][1] + " end", "s") for i in range(5)]
    rows += [(2000 + i, f"one very common line stands {i} here", "s") for i in range(100)]
    docs = frame(spark, rows).cache()
    docs.count()
    before = shuffled(spark)
    got = {(r.doc_id, r.class_id, r.n_links) for r in jaccard_join.jaccard_join(docs).collect()}
    assert got == {(i, i % 1000 if i < 2000 else i, int(i % 1000 < 5 and i < 2000)) for i, *_ in rows}
    assert shuffled(spark) - before < sum(len(r[1]) for r in rows) / 4


def brute_removed(rows, n=100):
    seen, out = set(), []
    for i, t, *_ in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if b[p : p + n] in seen:
                gone[p : p + n] = b"\1" * n
            else:
                seen.add(b[p : p + n])
        runs = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("pieces", [256, 1])
def test_suffix(spark, monkeypatch, pieces):
    monkeypatch.setattr(suffix_dedup, "PIECES", pieces)
    rows = [(i, (t or "") if i != 7 else None) for i, t, _ in corpus(6)]
    rows += [(20, "é" * 300), (21, "x" * 99), (22, "x" * 100), (23, "x" * 101)]
    assert Counter(map(tuple, suffix_dedup.suffix_dedup(frame(spark, rows)).collect())) == brute_removed(rows)


def test_suffix_hot_passages(spark, monkeypatch):
    """Lines of many lengths between unlike contexts, so that anchors meet in a great many pieces; and periodic texts."""
    monkeypatch.setattr(suffix_dedup, "PIECES", 3)
    rng = random.Random(8)
    some = lambda k: "".join(rng.choice("abcdefghij ") for _ in range(k))
    lines = [some(k) for k in (30, 76, 99, 100, 101, 150, 260)]
    rows = [(i, some(rng.randint(0, 120)) + rng.choice(lines) + some(rng.randint(0, 120)) + rng.choice(lines)[: rng.randint(20, 300)]) for i in range(160)]
    rows += [(1000 + i, ("ab" * 300)[i % 2 :] + some(i % 3) + "ab" * (40 + i)) for i in range(20)]
    assert Counter(map(tuple, suffix_dedup.suffix_dedup(frame(spark, rows)).collect())) == brute_removed(rows)


def test_suffix_odd_ids(spark):
    rows = [(1, "a" * 150), (1, "a" * 150), (None, "a" * 120), (1, "b" * 10), (None, None)]
    got = Counter(tuple(r)[:4] for r in suffix_dedup.suffix_dedup(frame(spark, rows)).collect())
    # within the first document all but the first string repeat it
    assert got == Counter({(1, 150, 149, 1): 2, (None, 120, 120, 1): 1, (1, 10, 0, 0): 1, (None, 0, 0, 0): 1})


def test_two_stage_sort():
    import numpy as np

    rng = random.Random(1)
    for t in range(200):
        alphabet = rng.choice([b"a", b"ab", b"abc", bytes(range(256))])
        s = bytes(rng.choice(alphabet) for _ in range(rng.randint(0, 300)))
        s += s[: len(s) // 2] * (t % 3)
        order = suffix_dedup.two_stage_sort(np.frombuffer(s, np.uint8), 20).tolist()
        assert sorted(order) == list(range(len(s)))
        keys = [s[i : i + 20] for i in order]
        assert keys == sorted(keys)
