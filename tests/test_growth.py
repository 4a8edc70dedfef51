"""Queries whose work must grow no faster than their input: what is shuffled, planned and held."""

from pyspark.sql import functions as F

from quillspark.operators import evaluate as ev

TEXTS = ["the right to freedom of all", "das Recht der Freiheit und das Recht", "право на свободу", "", None, "l'été déjà là, the the the", "123 !"]


def exchanges(df) -> str:
    """The physical plan as text."""
    return df._jdf.queryExecution().executedPlan().toString()


def test_confusions_are_planned_without_a_filter_on_detections(spark):
    """A filter on the kind of a row reached through the detection's columns, and planning did not end."""
    cases = spark.createDataFrame([("en", "Latn", TEXTS[0]), ("fr", "Latn", TEXTS[0]), ("de", "Latn", TEXTS[1]), ("ru", "Latn", TEXTS[2])], "expected_language string, script string, text string")
    rows = ev.evaluate(cases)
    found = ev.confusions(rows)
    assert "resolution" not in "".join(x for x in found._jdf.queryExecution().analyzed().toString().split("\n") if "Filter" in x)
    want = sorted((r.expected_language, r.predicted_language or "und") for r in rows.collect() if r.resolution == "wrong")
    assert sorted((r.expected_language, r.predicted) for r in found.collect() for _ in range(r.n)) == want and want


def test_ngrams_and_distances_of_rows_are_not_shuffled(spark):
    """They were dealt out by text and n-gram; the forms by rows give the same."""
    from quillspark.functions import text as tx
    from quillspark.operators import detect as dt
    from quillspark.operators import inrow

    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    features = dt.text_features(docs, "id", "text")
    far, top = dt.distances_in_rows(docs, "id"), dt.ngrams_in_rows(docs, "id")
    assert "hashpartitioning" not in exchanges(far) + exchanges(top) + exchanges(features)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(far) == rows(dt.rank_distances(features, "id"))
    want = dt.top_text_ngrams(features, "id").select("id", "ngram", "cnt", "rank")
    assert rows(top) == rows(want)
    totals = want.groupBy("ngram").agg(F.sum("cnt").alias("cnt"), F.count(F.lit(1)).alias("n_docs"))
    assert rows(inrow.gram_totals(docs, tx.tokens(tx.normalise(F.col("text"))))) == rows(totals)


def test_profiles_in_order_of_numbers_are_hashed(spark):
    from quillspark.operators import profiles as pf

    words = spark.createDataFrame([("k", 2, ["a", "b"]), ("k", -1, ["c", "b", "b"]), ("k", None, ["a"])], "key string, o long, w array<string>")
    got = pf.word_counts(words, ["key"], F.col("w"), "o")
    assert "SortAggregate" not in exchanges(got)
    assert sorted((r.word, r.cnt, r["first"].o, r["first"].pos) for r in got.collect()) == [("a", 2, None, 0), ("b", 3, -1, 1), ("c", 1, -1, 0)]


def test_words_beyond_plain_letters(spark):
    from quillspark.functions import rowlocal as rl
    from quillspark.functions import text as tx

    odd = ["a`b c'd''e", "l’été ‘x’", "日本 かな a1b", "", "٣ab٣"]
    rows = spark.createDataFrame([(t,) for t in odd], "t string").select("t", tx.tokens(F.col("t")).alias("w")).collect()
    assert {r.t: r.w for r in rows} == {t: [w for w in rl._word_pattern()[0].findall(t.translate(rl._FOLD))] for t in odd}


def test_cut_words_are_not_remembered():
    """A worker kept an array for each different word of hundreds of thousands, more of them the longer its task ran."""
    import random
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from quillspark.functions.rowlocal import Detector
    from quillspark.operators.profiles import STORE, load_profiles

    random.seed(9)
    detector, n = Detector(list(load_profiles(STORE))), 4000
    tracemalloc.start()
    for lot in range(12):
        words = pa.array([f"{''.join(random.choices('abcdefghijklmnop', k=12))}" for _ in range(n)])
        detector.far("Latn", 8, *detector.top(np.sort(np.arange(n) % 8), np.arange(n), words))
        if lot == 1:
            held = tracemalloc.get_traced_memory()[0]
    assert tracemalloc.get_traced_memory()[0] < held + (2 << 20)
    tracemalloc.stop()


def test_ngrams_cut_at_once_are_those_of_words():
    """Letters, pairs and n-grams are numbers: of any script, in lots of any size, and beyond what fits a packed number."""
    from collections import Counter

    import numpy as np
    import pyarrow as pa

    from quillspark.functions import rowlocal as rl
    from quillspark.operators import inrow
    from quillspark.operators.profiles import STORE, load_profiles

    many = ["".join(chr(c) for c in range(a, a + 40)) for a in range(0x4E00, 0x9F00, 40)]
    texts = [["the", "right", "the", "x"], [], ["право", "на", "l'été", "𐐨𐐩𐐪"], None, many, ["日本", "a"], ["the"] * 9 + ["that"]]
    detector, old = rl.Detector(list(load_profiles(STORE))), rl.KNOWN
    try:
        for rl.KNOWN in (1, 40, old):
            got = []
            for a, _, text, word, known in inrow._texts(pa.array(texts, pa.list_(pa.string()))):
                gram, count, text, rank = detector.top(text, word, known)
                got += zip((text + a).tolist(), rank.tolist(), detector.cut.names(gram).to_pylist(), count.tolist())
                ids = detector.fixed_ids
                assert detector.cut.rows(gram).tolist() == [ids.get(g, -1) for g in detector.cut.names(gram).to_pylist()]
            want = []
            for i, words in enumerate(texts):
                n = Counter()
                for w, times in Counter(words or ()).items():
                    for g in rl.grams_of(w):
                        n[g] += times
                want += [(i, r, *x) for r, x in enumerate(sorted(n.items(), key=lambda x: -x[1])[: rl.TOP])]
            assert got == want
    finally:
        rl.KNOWN = old
    keys = [np.array([2**40, 5, 2**40]), np.array([2**40, 1, 2**40])]
    assert [x.tolist() for x in rl.order(*keys)] == [[1, 0, 2], [0, 1]]


def test_evidence_of_languages_is_not_folded(spark):
    """Cue words and letters were folded over again for each of the candidates; now they are counted where the n-grams are."""
    from quillspark.operators import detect as dt

    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    assert "_letter_weights" not in exchanges(dt.detect(docs, "id"))


def test_texts_are_not_cut_to_find_words_without_a_letter(spark):
    from quillspark.functions import text as tx
    from quillspark.plans import queries as q

    odd = ["", " ", "a", "1", "a 1", "1 a", "1st 2nd", "a\u00a01", "a\u30001\u3000b", "a\u0085- b", "a\u200b- b", "été 日本 ٣", "ñ -\n", "-\n ñ", "a\n1", "𐐨 𝟏", "𝟏𐐨", "x" * 9, "1" * 200_000 + " a", "1" * 200_000 + "a", None]
    df = spark.createDataFrame([(t,) for t in odd], "t string")
    rows = df.select(tx.text_all_lexical(F.col("t")).alias("a"), tx.all_lexical(tx.split_words(F.col("t"))).alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows] and {r.a for r in rows} == {True, False, None}
    import inspect

    assert "split_words" not in inspect.getsource(q.eval_quality_checks)


def test_only_spans_are_not_detected_again(spark, monkeypatch):
    """Whole texts went through detection beside their spans, also where the only span is the text."""
    from quillspark.operators import detect as dt
    from quillspark.operators import mixed as mx

    texts = [*TEXTS, "the right to freedom of all. право на свободу!", "the right. The right to freedom"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    asked, real = [], mx.in_rows
    monkeypatch.setattr(mx, "in_rows", lambda df, text, *rest: (asked.append(str(text)), real(df, text, *rest))[1])
    found = mx.with_mixed_summary(docs, "id")
    assert "segments" in asked[-1] and not any(x == "Column<'_whole'>" for x in asked)
    rows = {r.id: r for r in found.collect()}
    whole = {r.id: r for r in dt.detect(docs, "id").collect()}
    assert len(rows) == len(texts) and {len(r.segments) for r in rows.values()} >= {0, 1, 2}
    for i, r in rows.items():
        assert (r.primary is None) == (texts[i] is None)
        if r.primary is not None:
            assert r.primary.asDict() == {k: v for k, v in whole[i].asDict().items() if k != "id"}
