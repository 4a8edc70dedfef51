"""Periodic runs, weak supervision and ranked search against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import periodic_runs as pr


def brute_runs(words, shortest=24, periods=3):
    n, out = len(words), set()
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(shortest, periods * q):
                stretch = words[i : j + q]
                if not any(all(stretch[k] == stretch[k + d] for k in range(len(stretch) - d)) for d in range(1, q)):
                    out.add((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(out)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=12), st.integers(1, 9)), min_size=1, max_size=6))
def test_runs_of_any_sequence(parts):
    words = [x for unit, times in parts for x in unit * times]
    code = np.array(words, np.int64)
    assert pr.runs_of(code) == brute_runs(words)
    assert pr.runs_of(code, 4, 2) == brute_runs(words, 4, 2)


def test_lag_counts_of_heavy_and_light_words():
    rng = random.Random(3)
    words = [0 if rng.random() < 0.6 else rng.randrange(1, 300) for _ in range(3000)]
    code = np.array(words, np.int64)
    got = pr.lag_counts(code, 1000)
    assert got.tolist() == [0] + [int((code[:-k] == code[k:]).sum()) for k in range(1, 1001)]


def test_a_very_long_text_of_one_word_and_of_two():
    assert pr.runs_of(np.zeros(400_000, np.int64)) == [(0, 400_000, 1)]
    assert pr.runs_of(np.arange(400_000) % 2) == [(0, 400_000, 2)]


def test_runs_inside_runs():
    words = (["a"] * 30 + ["b"]) * 4
    code = np.unique(words, return_inverse=True)[1]
    assert pr.runs_of(code) == brute_runs(words) and len(pr.runs_of(code)) == 5


def test_periodic_runs_of_odd_tables(spark):
    rows = [(1, None, "x"), (2, "", "x"), (2, " \t\n", "x"), (3, "a b " * 20 + "c", "x"), (3, "a b " * 20 + "c", "x"), (None, "ä b " * 30, None)]
    docs = spark.createDataFrame(rows, "id int, text string, Runs string")
    got = sorted(pr.periodic_runs(docs).collect(), key=repr)
    assert pr.periodic_runs(docs).columns == ["id", "runs", "n_words", "collapsed"]
    by = {(r["id"], r["collapsed"]): [tuple(x) for x in r["runs"]] for r in got}
    assert len(got) == 6 and by == {(1, ""): [], (2, ""): [], (3, "a b c"): [(0, 40, 2)], (None, "ä b"): [(0, 30, 1)]}
    assert pr.periodic_runs(docs.where("false")).count() == 0
    assert pr.periodic_runs(docs.select("text")).columns == ["runs", "n_words", "collapsed"]


def test_op11_against_brute_force(spark, tmp_path):
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 90)))) for i in range(300)] + [(301, None), (None, "x y"), (302, "w " * 5000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in pr.op11_periodic_runs(spark, str(tmp_path)).collect()}
    planted = 0
    for doc_id, text in rows:
        ws = (text or "").split()
        n, h = len(ws), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            ws, planted = [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)], planted + 1
        runs = brute_runs(ws)
        gone = {i for a, length, q in runs for i in range(a + q, a + length)}
        r = got[doc_id]
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None,) * 3)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (None if not runs else 1000 * best[1] // best[2])
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(w for i, w in enumerate(ws) if i not in gone).encode()).hexdigest()
    assert planted > 15


# --- op12 -------------------------------------------------------------------------------------

from quillspark.llm import quality_rules as qr  # noqa: E402
from quillspark.llm import ranked_search as rs  # noqa: E402

_WS = "[ \t\n\x0b\x0c\r]+"


def brute_counts(text):
    import re

    text = text or ""
    ws = [w for w in re.split(_WS, text) if w]
    lines = [x for x in text.split("\n") if re.sub(_WS, "", x)]
    wins = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    inside = {j for i, w in enumerate(wins) if wins.count(w) > 1 for j in range(i, i + 5)}
    return {
        "n_words": len(ws), "word_chars": sum(map(len, ws)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": sum(x in lines[:i] for i, x in enumerate(lines)), "n_repeat_words": len(inside), "n_lines": len(lines),
        "n_ended_lines": sum(x.strip(" \t\n\x0b\x0c\r")[-1] in qr.ENDS for x in lines), "n_letters": sum(c.isascii() and c.isalpha() for c in text),
        "n_capitals": sum("A" <= c <= "Z" for c in text), "n_exclamations": text.count("!"), "n_same_neighbours": sum(a == b for a, b in zip(ws, ws[1:], strict=False)),
        "n_distinct_words": len(set(ws)), "n_odd_words": sum(w[-1] in "#*$%&|<>@^_~=+/\\" for w in ws), "n_bare_words": sum(not any(c > "\x7f" or c.isalnum() for c in w) for w in ws),
    }


def test_counts_of_whole_texts(spark):
    rng = random.Random(5)
    pieces = ["a", "bé", "b", "A!", "x#", "|", "日本。", "\n", " \t", "\x0b", " ", "c.", "\n\n"]
    texts = [None, "", " ", "\n", "a b c d e a b c d e", *("".join(rng.choice(pieces) + rng.choice(["", " ", "\n"]) for _ in range(rng.randrange(1, 120))) for _ in range(200)), "w " * 300_000]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r["id"]: r.asDict() for r in qr.with_counts(spark.createDataFrame(rows, "id int, text string")).drop("text").collect()}
    for i, t in rows[:-1]:
        assert {k: got[i][k] for k in qr.COUNTS} == brute_counts(t), t
    assert got[len(rows) - 1]["n_repeat_words"] == 300_000 and got[len(rows) - 1]["n_distinct_words"] == 1


def _em(rows, rounds):
    """The estimation text by text, without kinds."""
    import math

    k = len(rows[0])
    good, g, b = 0.8, [0.95] * k, [0.3] * k
    for _ in range(rounds):
        p = []
        for v in rows:
            odds = math.log(good / (1 - good)) + sum(math.log(g[j] / (1 - b[j])) if x == 1 else math.log((1 - g[j]) / b[j]) if x == -1 else 0 for j, x in enumerate(v))
            p.append(1 / (1 + math.exp(-odds)))
        good = (sum(p) + 8) / (len(rows) + 10)
        for j in range(k):
            up, down = [v[j] == 1 for v in rows], [v[j] == -1 for v in rows]
            w, v_ = sum(q for q, u in zip(p, up) if u), sum(q for q, u in zip(p, down) if u)
            x, y = sum(1 - q for q, u in zip(p, up) if u), sum(1 - q for q, u in zip(p, down) if u)
            g[j], b[j] = (w + 9.5) / (w + v_ + 10), (y + 3) / (x + y + 10)
            if g[j] < 1 - b[j]:
                g[j] = (sum(up) + 9.5) / (sum(up) + sum(down) + 10)
                b[j] = 1 - g[j]
    return good, g, b


def test_estimation_is_that_of_every_text_and_finds_planted_shares():
    rng = random.Random(7)
    truth = [rng.random() < 0.8 for _ in range(4000)]
    on_good, on_bad = [0.97, 0.9, 0.99, 0.95], [0.7, 0.6, 0.8, 0.4]
    rows = [[0 if rng.random() < 0.2 else (1 if rng.random() < g else -1) if t else (-1 if rng.random() < b else 1) for g, b in zip(on_good, on_bad, strict=True)] for t in truth]
    kinds = sorted({tuple(r) for r in rows})
    many = np.array([sum(tuple(r) == k for r in rows) for k in kinds], float)
    got = qr.estimate(np.array(kinds), many, 5)
    assert np.allclose(np.hstack(_em(rows, 5)), np.hstack(got[:3]), atol=1e-9)
    good, g, b, rounds = qr.estimate(np.array(kinds), many)
    assert rounds < qr.ROUNDS and abs(good - 0.8) < 0.05 and np.abs(g - on_good).max() < 0.05 and np.abs(b - on_bad).max() < 0.12


def test_quality_of_odd_tables(spark):
    good = "Here is a plain line of prose that goes on for a while.\nAnd another one, which ends as well, with other words in it."
    rows = [(i, good + f" Number {i} of them.", "a") for i in range(60)] + [(100 + i, f"THIS IS LOUD!! {i} BUY!! NOW!! AND!! THEN!! MORE!! OF!! IT!! {i * 7}!! YES!!", "b") for i in range(10)] + [(None, None, None), (7, "", "c"), (7, good, "c"), (7, good, "c")]
    docs = spark.createDataFrame(rows, "doc_id int, Text string, KEPT string")
    got = qr.judged(docs, "Text", keep_text=False).collect()
    assert len(got) == len(rows) and all(not r["kept"] for r in got if r["doc_id"] is None or r["doc_id"] >= 100) and sum(r["kept"] for r in got) == 62
    kept = qr.drop_poor(docs, "Text")
    assert kept.columns == docs.columns and kept.count() == 62
    assert qr.judged(docs.where("false"), "Text", keep_text=False).count() == 0 and qr.drop_poor(docs.where("false"), "Text").count() == 0


# --- op13 -------------------------------------------------------------------------------------


def brute_search(docs, items, top):
    import math
    import re

    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    terms = [(d, cut(t)) for d, t in docs]
    n_docs, n_all = sum(bool(x) for _, x in terms), sum(len(x) for _, x in terms)
    df = {}
    for _, x in terms:
        for t in set(x):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        scores = []
        for d, x in terms:
            m = 50 + (50 * len(x) * n_docs) // n_all if x else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * x.count(t)) // (1000 * x.count(t) + 20 * m)) for t in set(cut(text)) if t in x)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, k, d, -s) for k, (s, _, _, d) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("window", "max_terms", "top"), [(4096, 1 << 16, 50), (3, 1 << 16, 4), (8, 6, 3)])
def test_ranked_search_against_brute_force(spark, window, max_terms, top):
    rng = random.Random(13)
    words = ["a", "B", "b", "ça", "x1", "日本", "zz", "the", "q"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n)) + rng.choice(["", "!", " -- "])
    docs = [(i * 7 % 101, text(rng.randrange(0, 12))) for i in range(90)] + [(None, "zz a"), (500, None), (501, ""), (502, "zz " * 2000), (3, "zz a"), (3, "zz a")]
    items = [(i, text(rng.randrange(0, 6))) for i in range(12)] + [(50, None), (51, "nothing known"), (52, "zz ZZ a")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", rs.F.lit("x")).repartition(5)
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("terms", rs.F.lit(1))
    got = rs.ranked_search(d, i, top=top, window=window, max_terms=max_terms)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_search(docs, items, top)


def test_ranked_search_of_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert rs.ranked_search(d.where("false"), d.withColumnRenamed("doc_id", "item_id")).count() == 0
    assert rs.ranked_search(d, d.withColumnRenamed("doc_id", "item_id").where("false")).count() == 0


# --- mends of earlier operators ----------------------------------------------------------------

from quillspark.llm import decontaminate, mixing, quote_links, secret_scan, token_counts, warc  # noqa: E402


@pytest.mark.parametrize("rows", [[(1, None, "a"), (3, "x y", "b")], [(1, None, "a"), (2, "", "b"), (3, " \n", None)], [(1, "a b c", "x"), (2, " ", "y"), (3, "d", "z"), (4, None, None)]])
def test_mix_of_sources_without_words(spark, rows):
    got = {r["doc_id"]: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(len((t or "").split()) for _, t, x in rows if x == s) for s in names}
    left, weight, goal = float(sum(size.values())), {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, {}
    while True:  # the limits, found one by one
        over = [s for s in weight if left * weight[s] / sum(weight.values()) > 3 * size[s]]
        if not over:
            break
        for s in over:
            goal[s] = 3.0 * size[s]
            del weight[s]
        left = sum(size.values()) - sum(goal.values())
        if not weight:
            break
    goal |= {s: left * w / sum(weight.values()) for s, w in weight.items()}
    assert len(got) == len(rows)
    for i, t, s in rows:
        assert (got[i]["size"], got[i]["source_size"], round(got[i]["target"], 9)) == (len((t or "").split()), size[s], round(goal[s], 9))
        assert got[i]["taken"] <= 3 * got[i]["size"]


def test_archives_of_two_writes_into_one_folder(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}</p>") for i in range(8)], "page_id long, url string, html string")
    for part in ("page_id < 5", "page_id >= 5"):
        warc.write_warc(warc.records(pages.where(part)), str(tmp_path / "w"))
    assert sorted(r["page_id"] for r in warc.read_warc(spark, str(tmp_path / "w")).collect()) == list(range(8))


def test_null_threads_link_across_blocks_and_names_differ_by_case(spark):
    rows = [(c, o, t) for c in (1, None) for o, t in ((3, "A passage that is\nquoted later."), (4000, "> A passage that is\n> quoted later.\n\nYes."))]
    mail = spark.createDataFrame(rows, "conv_id long, turn long, text string").withColumn("Parent", rs.F.lit("x")).withColumn("OWN", rs.F.lit(1))
    got = quote_links.reply_order(quote_links.link_quotes(mail, "conv_id", "turn"), "conv_id", "turn")
    assert sorted((r["conv_id"] is None, r["turn"], r["parent"], r["root"], r["linked"]) for r in got.collect()) == [(n, o, p, 3, int(o > 3)) for n in (False, True) for o, p in ((3, None), (4000, 3))]
    assert [c.lower() for c in got.columns].count("parent") == 1


def test_long_strings_bound_what_is_learnt(spark):
    rng = random.Random(9)
    blob = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n))
    rows = [(i, f"text token={blob(40)} and {blob(20_000)} end") for i in range(40)] + [(100 + i, f"secret: {blob(500)} {blob(400)}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    by = secret_scan.examples(docs)
    assert all(len(w) <= secret_scan.LONGEST for words in by.values() for w in words) and all(sum(map(len, words)) <= secret_scan.SAMPLE_CHARS for words in by.values())
    assert len(by["assign"]) > 40 and len(by["other"]) > 40
    got = {r["doc_id"]: r for r in secret_scan.secret_scan(docs).collect()}
    assert len(got) == 340 and all(r["n_assign"] == 1 for r in got.values())


def test_null_item_ids_and_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "a b")], "item_id long, text string")
    r = decontaminate.decontaminate(d, bench).first()
    assert (r["n_words"], r["n_hit"], r["n_items"]) == (3, 2, 0)
    assert token_counts.token_counts(d.where("false")).count() == 0
