"""Profiles, evaluation, corpus statistics, readers, sampling and transliteration."""

import bz2
from collections import Counter

import pytest
from pyspark.sql import functions as F
from quillspark.functions import rowlocal
from quillspark.functions import text as tx
from quillspark.functions.transliterate import uyghur_cyrillic, uyghur_latin, uyghur_new_script
from quillspark.operators import corpus as cp
from quillspark.operators import evaluate as ev
from quillspark.operators import profiles as pf
from quillspark.operators import sampling as sm
from quillspark.sources import readers, sinks


def test_profile_order(spark):
    text = "Ba ba ab, abc! don't cab ab"
    rows = pf.build_profiles(spark.createDataFrame([("k", text)], "key string, text string"), ["key"], size=12).orderBy("rank").collect()
    counts: Counter = Counter()
    for w in rowlocal.tokens(rowlocal.normalise(text)):
        counts.update(f"^{w}$"[i : i + n] for n in (2, 3, 4) for i in range(len(w) + 3 - n))
    assert [(r.ngram, r.cnt) for r in rows] == counts.most_common(12)


def test_profile_of_several_rows(spark):
    """Rows of one key are one text in their order: ties go to what is seen first over all rows."""
    texts = ["zz ab", "ab zz cd", "cd ef"]
    rows = spark.createDataFrame([("k", 10 - i, t) for i, t in enumerate(reversed(texts))], "key string, place int, text string").repartition(3)
    got = [r.ngram for r in pf.build_profiles(rows, ["key"], size=30, order="place").orderBy("rank").collect()]
    counts: Counter = Counter()
    for w in " ".join(texts).split():
        counts.update(f"^{w}$"[i : i + n] for n in (2, 3, 4) for i in range(len(w) + 3 - n))
    assert got == [g for g, _ in counts.most_common(30)]


def test_case_checks(spark):
    cases = spark.createDataFrame([("k", "a", 1001, 1002), ("k", "b", 1003, 1009), ("k", "c", 1009, 1011), ("m", "d", 990, 1001), ("m", "e", 1002, 1003)], "key string, id string, start int, end int")
    assert {r.id for r in ev.overlaps(cases, "key", "start", "end", after=1000).collect()} == {"c", "d"}
    want = spark.createDataFrame([("k", 3), ("m", 5), ("x", 1)], "key string, n long")
    assert {tuple(r) for r in ev.bucket_differences(cases, want, ["key"]).collect()} == {("m", 2, 5), ("x", 0, 1)}
    held = sm.held_out_cases(spark.createDataFrame([("k", " ".join(f"w{i}" for i in range(900)))], "key string, text string"), skip=50, lengths=(5, 10, 20))
    assert ev.overlaps(held, "key", "line_start", "line_end", after=50).isEmpty()


def test_least_share_of_script(spark):
    lines = spark.createDataFrame([("k", i, f"слово{i} ещё раз" if i % 2 else f"word{i} once more") for i in range(40)], "key string, line int, text string")
    texts = [r.text for r in sm.window_cases(lines, lengths=(3,), per_length=4, script="Cyrl", min_share=0.95).collect()]
    assert len(texts) == 4 and all("more" not in t and "word" not in t for t in texts)


def test_windows_are_too_few(spark):
    lines = spark.createDataFrame([("k", i, "1 2 3") for i in range(20)] + [("m", 1, "a b")], "key string, line int, text string")
    for key, n in (("k", 1), ("m", 5)):
        with pytest.raises(Exception, match="no further window"):
            sm.window_cases(lines.where(F.col("key") == key), lengths=(n,), per_length=2).collect()
    text = spark.createDataFrame([("k", "a b a b a b a b a b a b c d e f g h")], "key string, text string")
    got = sm.held_out_cases(text, lengths=(1, 2), per_length=2, skip=4, unique=True).collect()
    assert len({(r.word_count, r.text) for r in got}) == len(got) == 4 and min(r.line_start for r in got) >= 5
    with pytest.raises(Exception, match="too short"):
        sm.held_out_cases(text, lengths=(9,), per_length=2, skip=4).collect()


def test_word_functions(spark):
    df = spark.createDataFrame([(" a  b c\n12 d-e ",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(tx.first_words(F.col("t"), 3)).collect()] == ["a b c", "", None]
    full = df.where("t like ' a%'")
    assert full.select(tx.first_words_laid_out(F.col("t"), 2)).first()[0] == " a  b"
    with pytest.raises(Exception, match="fewer than 9"):
        full.select(tx.first_words_laid_out(F.col("t"), 9)).collect()
    assert full.select(tx.lexical_words(F.col("t"))).first()[0] == ["a", "b", "c", "d-e"]
    assert df.select(tx.ordered_unique(F.array(F.lit("b"), F.lit(None), F.lit("a"), F.lit("b")))).first()[0] == ["b", "a"]
    assert df.select(tx.percentage(F.lit(1369), F.lit(2048)), tx.percentage(F.lit(0), F.lit(0))).first()[:] == ("66.8%", "n/a")


def test_transliteration(spark):
    alphabet = "ا ە ب پ ت ج چ خ د ر ز ژ س ش غ ف ق ك گ ڭ ل م ن ھ و ۇ ۆ ئۈ ۋ ې ى ي"
    row = spark.createDataFrame([(alphabet, "يا يۇ يو")], "t string, i string").select(uyghur_latin(F.col("t")), uyghur_cyrillic(F.col("t")), uyghur_new_script(F.col("t")), uyghur_cyrillic(F.col("i"))).first()
    assert row[0] == "a e b p t j ch x d r z zh s sh gh f q k g ng l m n h o u ö ü w ë i y"
    assert row[1] == "а ә б п т җ ч х д р з ж с ш ғ ф қ к г ң л м н һ о у ө ү в е и й"
    assert row[2] == "a ə b p t j q h d r z ⱬ s x ƣ f ⱪ k g ng l m n ⱨ o u ɵ ü w e i y"
    assert row[3] == "я ю ё"


def test_paragraphs(spark):
    html = '<script>var t="</p>";</script><p>A <b>b</b>\n c &amp; d</p><p>lost<p>kept</p><p> </p>out</p><p>open'
    assert readers.paragraphs_of(html) == ["A b c & d", "kept"]
    assert spark.createDataFrame([(html,), (None,)], "h string").select(readers.paragraphs(F.col("h"))).collect()[1][0] is None


def test_readers(spark, tmp_path):
    (tmp_path / "xx").mkdir()
    (tmp_path / "xx/sample.txt").write_text("one\ntwo")
    (tmp_path / "xx/sample_latn.txt").write_text("drei")
    got = {r.label: (r.path, r.text) for r in readers.read_samples(spark, str(tmp_path)).collect()}
    assert got == {"xx": ("xx/sample.txt", "one\ntwo"), "xx/latn": ("xx/sample_latn.txt", "drei")}
    (tmp_path / "l.txt").write_text(" a \n\n  \né\n")
    assert [(r.line, r.text) for r in readers.read_sentences(spark, str(tmp_path / "l.txt")).collect()] == [(1, "a"), (2, "é")]
    (tmp_path / "c.conllu").write_text("# text_ortho = How far\n1\tHow\n# text = no\n# text_ortho =  \n")
    assert [r.text for r in readers.read_conllu_texts(spark, str(tmp_path / "c.conllu")).collect()] == ["How far"]
    (tmp_path / "t.tsv.bz2").write_bytes(bz2.compress("7\tuzb\tЎз\tбек\n8\tuzb\tLotin\n".encode()))
    rows = readers.read_sentence_export(spark, str(tmp_path / "t.tsv.bz2"))
    assert [r.text for r in rows.where(readers.cyrillic_majority(F.col("text"))).collect()] == ["Ўз\tбек"]
    digests = readers.file_digests(spark, str(tmp_path / "l.txt"))
    with pytest.raises(Exception, match="digest of"):
        readers.require_digest(digests, {"l.txt": "00"}).collect()
    assert readers.require_digest(digests, {"l.txt": digests.first().sha256}).count() == 1


def test_cases_round_trip(spark, tmp_path):
    lines = spark.createDataFrame([("k", i, f"alpha{i} beta gamma delta{i} word") for i in range(60)], "key string, line int, text string")
    a = sm.window_cases(lines, lengths=(1, 3, 7), per_length=4)
    rows = a.collect()
    assert a.collect() == rows and len(rows) == 12
    assert len({r.text for r in rows}) == len({r.line_start for r in rows}) == 12
    assert all(len(r.text.split()) == r.word_count for r in rows)
    cases = sm.case_ids(a, "en").select("id", "text", "word_count", F.lit("en").alias("expected_language"), F.lit("Latn").alias("script"))
    sinks.write_cases(cases, str(tmp_path / "c"))
    back = readers.read_cases(spark, str(tmp_path / "c"))
    assert back.count() == 12 and back.first().variety is None and back.first().source is None
    held = sm.held_out_cases(spark.createDataFrame([("k", " ".join(f"w{i}" for i in range(300)))], "key string, text string"), lengths=(2, 5), skip=100, max_gap=3).orderBy("line_start").collect()
    assert held[0].line_start >= 101 and all(x.line_end < y.line_start for x, y in zip(held, held[1:], strict=False))
    assert held[0].text == " ".join(f"w{i - 1}" for i in range(held[0].line_start, held[0].line_end + 1))
    uy = spark.createDataFrame([("ug-1", "چاي", "Arab", 1)], "id string, text string, script string, word_count int")
    assert {(r.id, r.text, r.script) for r in sm.uyghur_variants(uy).collect()} == {("ug-1-uly", "chay", "Latn"), ("ug-1-uky", "чай", "Cyrl"), ("ug-1-uyy", "qay", "Latn")}
    assert sm.line_samples(lines, words=7).first().text == "alpha0 beta gamma delta0 word alpha1 beta"


def test_predictions(spark):
    df = spark.createDataFrame([(" DE ", ("en", "latin"), (None, "fr"), ["uz", "x"], ("Cyrillic",))], "a string, b struct<language: string, alphabet: string>, c struct<language_code: string, language: string>, d array<string>, e struct<script: string>")
    got = {c: df.select(*ev.parse_prediction(df, c)).first()[:] for c in "abcde"}
    assert got == {"a": ("de", "Latn"), "b": ("en", "Latn"), "c": (None, None), "d": ("uz", None), "e": (None, "Cyrl")}
    with pytest.raises(ValueError):
        ev.parse_prediction(spark.createDataFrame([((1,),)], "x struct<n: int>"), "x")
    with pytest.raises(TypeError):
        ev.parse_prediction(spark.createDataFrame([(1,)], "x int"), "x")


def test_predictions_of_unknown_shape(spark):
    from pyspark.sql import types as T

    shapes = [
        ('{"language_code": null, "language": "fr", "script": "latin"}', None, "Latn"),
        ('{"language": " UZ ", "alphabet": null, "script": "x"}', "uz", "x"),
        ('{"code": "de", "n": 1}', "de", "Latn"),
        ('{"n": 1}', None, None),
    ]
    rows = spark.createDataFrame([(j,) for j, _, _ in shapes], "j string")
    as_map = rows.select("j", F.from_json("j", "map<string, string>").alias("p"))
    as_variant = rows.unionByName(spark.createDataFrame([('"Cyrillic"',), ('["en", 0.5]',), ('"und"',), (None,)], "j string")).select("j", F.parse_json("j").alias("p"))
    assert isinstance(as_variant.schema["p"].dataType, T.VariantType)
    want = {j: (language, script) for j, language, script in shapes}
    for frame in (as_map, as_variant):
        got = {r[0]: (r[1], r[2]) for r in frame.select("j", *ev.parse_prediction(frame, "p")).collect()}
        assert {j: got[j] for j in want} == want
    assert {j: got[j] for j in ('"Cyrillic"', '["en", 0.5]', '"und"', None)} == {'"Cyrillic"': (None, "Cyrl"), '["en", 0.5]': ("en", "Latn"), '"und"': (None, None), None: (None, None)}


def test_evaluation(spark):
    rows = [("en", "Latn", "en", 1, None), ("en", "Latn", "und", 1, "x"), ("de", "Latn", "fr", 2, "x"), ("ru", "Cyrl", "ru", 2, None), ("uz", "Cyrl", "uz", 2, None)]
    cases = spark.createDataFrame([(f"c{i}", *r, None) for i, r in enumerate(rows)], "id string, expected_language string, script string, guess string, word_count int, variety string, alphabet string")
    out = ev.evaluate(cases, lambda df: df.withColumn("detection", F.struct(F.col("guess").alias("code"), F.when(F.col("guess") == "und", "latin").alias("script"))))
    assert [r.resolution for r in out.orderBy("id").collect()] == ["language", "script", "wrong", "language", "wrong"]
    total = ev.totals(out).first()
    assert (total.cases, total.exact, total.script_only, total.wrong, total.attempted, total.useful_share) == (5, 2, 1, 2, 4, "60.0%")
    by = {(r.grouping, r.word_count, r.expected_language, r.script, r.variety): r.cases for r in ev.breakdown(out).collect()}
    assert by["word_count", 2, None, None, None] == 3 and by["expected_language/variety", None, "de", None, "x"] == 1
    assert not any(k[0] == "expected_language/alphabet" for k in by) and by["expected_language/script", None, "en", "Latn", None] == 2
    assert [(r.expected_language, r.predicted, r.n) for r in ev.confusions(out).collect()] == [("de", "fr", 1), ("uz", "uz", 1)]


def test_corpus(spark):
    docs = spark.createDataFrame([("a", 1, "Straße aa bb aa"), ("b", 1, "aa cc é"), ("c", 1, "где"), ("c", 2, "漢字")], "s string, d int, t string")
    letters = cp.char_counts(docs, "s", "t")
    assert {(r.sample, r.char, r.n) for r in cp.exclusive_letters(letters).where("sample in ('a', 'b')").collect()} == {("a", "s", 3), ("a", "e", 1), ("a", "t", 1), ("a", "r", 1), ("a", "b", 2), ("b", "c", 2), ("b", "é", 1)}
    shares = {(r.sample, r.script): r.share for r in cp.script_shares(letters).collect()}
    assert shares["c", "Cyrillic"] == 0.6 and shares["c", "Han"] == 0.4
    words = cp.sample_words(docs, "s", "d", "t")
    assert [(r.word, r.n) for r in cp.top_words(words, 2).where("sample = 'a'").orderBy("rank").collect()] == [("aa", 2), ("bb", 1)]
    assert {r.bigram for r in cp.top_bigrams(words).where("sample = 'a'").collect()} == {"strasse aa", "aa bb", "bb aa"}
    text = cp.format_counts(cp.top_words(words, 2), ["sample"], "word").where("sample = 'a'").first().counts
    assert text == "aa:2 bb:1"


def test_registered_queries():
    import __spark_entry__

    names, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(names) and len(names) >= 36
