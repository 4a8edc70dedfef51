"""Detection of texts: known sentences, rules, and that the forms agree."""

import json
import random
import unicodedata

import pytest
from pyspark.sql import functions as F
from quillspark.functions import charsets, rowlocal
from quillspark.functions import text as tx
from quillspark.operators import detect as dt
from quillspark.operators import mixed as mx
from quillspark.operators.profiles import load_profiles
from quillspark.resources import fixed

D = rowlocal.Detector(list(load_profiles()))
#: (text, script, language, resolution)
GOLDEN = [
    ("123 — !!!", None, None, "none"),
    ("", None, None, "none"),
    ("Ελλάδα", None, None, "none"),
    ("ї", "Cyrl", "uk", "language"),
    ("ښ", "Arab", "ps", "language"),
    ("ڭ", "Arab", "ug", "language"),
    ("а", "Cyrl", None, "script"),
    ("و", "Arab", None, "script"),
    ("ğ", "Latn", None, "script"),
    ("ٹ", "Arab", None, "script"),
    ("oʻzbekiston respublikasi", "Latn", "uz", "language"),
    ("İLE", "Latn", "tr", "language"),
    ("GMT کې د", "Arab", None, "script"),
    ("the right to freedom", "Latn", "en", "language"),
    ("这是一个用于测试的中文句子", "Hani", "zh", "language"),
    ("これはテストのための日本語の文です", "Jpan", "ja", "language"),
    ("Всеки път, когда человек имеет право на это, он не должен", "Cyrl", "ru", "language"),
    ("Der Mensch ist frei und hat das Recht auf Leben und nicht auf Gewalt", "Latn", "de", "language"),
    ("Les gens ont le droit de vivre dans la paix et pour la liberté", "Latn", "fr", "language"),
    ("Todos tienen derecho a la vida y a la libertad en el mundo", "Latn", "es", "language"),
    ("Mọi người đều có quyền sống và được tự do", "Latn", "vi", "language"),
    ("How una dey? I dey kampe, wetin dey happen for there", "Latn", "pcm", "language"),
]


@pytest.mark.parametrize("case", GOLDEN, ids=[g[0][:12] for g in GOLDEN])
def test_golden(case):
    text, script, language, resolution = case
    r = D.detect(text)
    assert (r["script"], r["language_code"], r["resolution"]) == (script, language, resolution)
    if script:
        assert abs(sum(a["score"] for a in r["alternatives"]) - 1) < 1e-4
        assert r["label"] == f"{fixed.SCRIPT_NAMES[script]} · {fixed.LANGUAGE_NAMES.get(language, 'uncertain')}"
    else:
        assert r["confidence"] == 0 and r["alternatives"] == []


def test_tables():
    assert sum(map(len, fixed.CUES.values())) == 658 and sum(map(len, fixed.unique_cues().values())) == 530
    assert sum(map(len, fixed.DISTINCTIVE.values())) == 109 and len(fixed.PROFILES) == 52 and len(fixed.LANGUAGE_NAMES) == 37
    assert [p["profile_key"] for p in load_profiles()] == [p[0] for p in fixed.PROFILES]
    assert {len(p["ngrams"]) for p in load_profiles()} == {1, 800}
    assert sum(len(charsets.ranges()[s]) for s in charsets.SCRIPTS) > 150


def test_rules():
    assert rowlocal.tokens("don't a''b 'x' ʻaʼ") == ["don't", "a", "b", "x", "a"]
    assert rowlocal.normalise("İŞ ﬁ ß") == "iş fi ss"
    assert D.detect("漢字 と 漢字")["script"] == "Jpan"
    assert D.detect("ABC где")["script"] == "Cyrl"  # as many letters: not Latin
    assert D.detect("x" * 5 + " где")["script"] == "Latn"
    assert D.detect(("This is a long English sentence. " * 1000).strip())["language_code"] == "en"
    assert D.detect(None) is None


TEXTS = [g[0] for g in GOLDEN] + [
    None,
    "The museum is called Государственный Эрмитаж расположен в Санкт-Петербурге, and it is in the city.",
    "Moscow (Russian: Москва) is the capital of Russia.",
    "This is an English sentence. Oʻzbekiston respublikasi mustaqil davlat.",
    "This is the first sentence. This is the second sentence.",
    "... 12. Hello there my friend of the world\r\n3.4: und das ist ein Satz in der Zeitung!?  99",
    "हिंदी में यह एक वाक्य है",
    "漢字です。漢字",
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string").repartition(3)


def test_forms_agree(spark, texts):
    local = {r.id: r.d for r in dt.with_detection(texts, out_col="d").collect()}
    relational = {r.id: r for r in dt.detect(texts, "id").collect()}
    assert local.keys() == relational.keys() == set(range(len(TEXTS)))
    for i, text in enumerate(TEXTS):
        want = D.detect(text)
        if want is None:
            assert local[i] is None and relational[i].script is None and relational[i].resolution is None
            continue
        for got in (local[i], relational[i]):
            assert (got.script, got.language_code, got.resolution, got.label) == tuple(want[k] for k in ("script", "language_code", "resolution", "label")), text
            assert got.confidence == pytest.approx(want["confidence"], abs=2e-6)
            assert [a.language_code for a in got.alternatives] == [a["language_code"] for a in want["alternatives"]]
            assert [a.score for a in got.alternatives] == pytest.approx([a["score"] for a in want["alternatives"]], abs=2e-6)


def test_batches_agree(spark):
    """A text has the same result alone, in a batch, and when words are forgotten in between."""
    words = [w for t in TEXTS if t for w in t.split()]
    texts = [*TEXTS, *(" ".join(words[i : i + 40]) for i in range(0, len(words), 7))]
    want = [D.detect(t) for t in texts]
    assert D.detect_all(texts) == want
    small = rowlocal.Detector(list(load_profiles()))
    old = rowlocal.KNOWN, rowlocal.ROWS
    try:
        rowlocal.KNOWN, rowlocal.ROWS = 10, 100
        assert small.detect_all(texts) == want
    finally:
        rowlocal.KNOWN, rowlocal.ROWS = old
    assert D.mixed_all(texts) == [D.mixed(t) for t in texts]


@pytest.mark.parametrize("bad", ["id", "array(text)", "encode(text, 'utf-8')"])
def test_only_strings(spark, texts, bad):
    odd = texts.selectExpr("id", f"{bad} as t")
    for run in (lambda: dt.detect(odd, "id", "t"), lambda: dt.with_detection(odd, "t"), lambda: dt.with_mixed(odd, "t"), lambda: mx.mixed_spans(odd, "id", "t")):
        with pytest.raises(TypeError, match="must hold strings"):
            run()


def test_narrow_input_is_spread(spark, tmp_path):
    """One row group is one task's work, however small the splits: detection deals it out first."""
    spark.range(400).selectExpr("id", "concat('some text ', id) as text").coalesce(1).write.parquet(str(tmp_path / "one"))
    docs = spark.read.parquet(str(tmp_path / "one"))
    sizes = dt.with_detection(docs).select(F.spark_partition_id().alias("p"), "detection").where("detection is not null").groupBy("p").count().collect()
    assert len(sizes) == spark.sparkContext.defaultParallelism and max(r["count"] for r in sizes) <= 110


def test_relational_plan_shuffles_text_once(spark, texts):
    plan = dt.rank_distances(dt.text_features(texts, "id", "text"), "id")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_spans_agree(spark, texts):
    local = {r.id: r.m for r in dt.with_mixed(texts, out_col="m").collect()}
    spans = {}
    for r in mx.mixed_spans(texts, "id").orderBy("start").collect():
        spans.setdefault(r.id, []).append(r)
    summary = {r.id: r for r in mx.mixed_summary(mx.mixed_spans(texts, "id"), "id").collect()}
    for i, text in enumerate(TEXTS):
        if text is None:
            assert local[i] is None and i not in spans
            continue
        want = D.mixed(text)
        key = lambda s: (s["start"], s["end"], s["text"], s["script"], s["language_code"])
        assert [key(s) for s in local[i].segments] == [key(s) for s in spans.get(i, [])] == [key(s) for s in want["segments"]], text
        assert "".join(s.text for s in local[i].segments) == text
        for s in local[i].segments:
            assert text[s.start : s.end] == s.text
        if want["segments"]:
            assert (summary[i].scripts, summary[i].language_codes, summary[i].is_mixed, summary[i].has_unresolved_segments) == (want["scripts"], want["language_codes"], want["is_mixed"], want["has_unresolved_segments"])


def test_mixed_known():
    kinds = lambda t: [(s["script"], s["language_code"]) for s in D.spans(t)]
    assert kinds(TEXTS[len(GOLDEN) + 1]) == [("Latn", "en"), ("Cyrl", "ru"), ("Latn", "en")]
    assert kinds(TEXTS[len(GOLDEN) + 3]) == [("Latn", "en"), ("Latn", "uz")]
    assert kinds(TEXTS[len(GOLDEN) + 4]) == [("Latn", "en")]
    assert D.mixed("")["segments"] == [] and not D.mixed("")["has_unresolved_segments"]
    assert len(D.mixed("123 — !!!")["segments"]) == 1 and D.mixed("123")["has_unresolved_segments"]
    moscow = next(s for s in D.spans(TEXTS[len(GOLDEN) + 2]) if s["script"] == "Cyrl")
    assert moscow["language_code"] is None and moscow["alternatives"][0]["language_code"] == "ru"
    json.dumps(D.mixed("English and Русский текст."))


def test_sql_functions(spark, texts):
    dt.register(spark)
    texts.createOrReplaceTempView("some_texts")
    got = spark.sql("SELECT id, detect_language(text).language_code AS l FROM some_texts WHERE id = 13").first()
    assert got.l == "en"
    rows = spark.sql("SELECT s.* FROM some_texts, LATERAL detect_spans(text) s WHERE id = 23 ORDER BY s.start").collect()
    assert [(r.script, r.language_code) for r in rows] == [("Latn", "en"), ("Cyrl", "ru"), ("Latn", "en")]


def test_script_functions(spark, texts):
    rows = texts.select("id", tx.script_counts(tx.normalise(F.col("text"))).alias("c"), tx.script_share(F.col("text"), "Jpan").alias("j")).collect()
    for r in rows:
        text = TEXTS[r.id]
        if text is None:
            continue
        found = rowlocal.scripts_at(rowlocal.normalise(text))
        assert {s: n for s, n in r.c.asDict().items() if n} == {s: sum(x == s for _, x in found) for s in {x for _, x in found}}
    assert {r.id: r.j for r in rows}[15] == 1.0


def test_stream_equals_batch(spark, texts, tmp_path):
    from quillspark.streaming import detect as st

    texts.write.parquet(str(tmp_path / "in"))
    stream = st.read_text_stream(spark, str(tmp_path / "in"), "id long, text string", files_per_trigger=1)
    q = st.write_stream(st.detect_stream(stream).select("id", "detection.language_code"), str(tmp_path / "out"), str(tmp_path / "c"))
    q.awaitTermination(120)
    got = {r.id: r.language_code for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {i: (D.detect(t) or {"language_code": None})["language_code"] for i, t in enumerate(TEXTS)}


def test_boundaries_are_columns(spark):
    rng = random.Random(1)
    parts = ["a", "B", "é", "ж", "Я", "ب", "漢", "ひ", "カ", "א", "अ", "ि", "!", "?.", "\r\n", "\r", "\n", " ", "\t", "\x0b", ";", "1", "", "😀", "𠀀", "\ue000"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 60))) for _ in range(400)] + ["x. " * 3000, "漢a" * 700, ""]
    d = spark.createDataFrame([*enumerate(texts), (-1, None)], "i int, t string")
    for i, t, ends, changes in d.select("i", "t", tx.clause_ends(F.col("t")), tx.script_changes(F.col("t"))).collect():
        assert (ends, changes) == (([m.end() for m in rowlocal.CLAUSE.finditer(t)], rowlocal.script_changes(t)) if i >= 0 else (None, None)), t
    runs = d.where("i = 401").select(tx.script_runs(F.col("t"))).first()[0]
    assert [tuple(r) for r in runs[:3]] == [("Hani", 1), ("Latn", 2), ("Hani", 3)] and len(runs) == 1400


def test_normal_forms_are_columns(spark):
    texts = ["ﬁne Straße İstanbul", "e\u0301 Å ẛ̣ q\u0323\u0307 q\u0307\u0323", "Ǆ ŉ ΐ ﷺ 한글 ᄒ\u1161\u11ab ｶﾞ", "", "plain ASCII"]
    d = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    t = F.col("t")
    for r in d.select("t", tx.nfc(t).alias("nfc"), tx.nfkc(t).alias("nfkc"), tx.nfc_casefold(t).alias("fold"), tx.normalise(t).alias("norm")).collect():
        n = unicodedata.normalize
        want = (None,) * 4 if r.t is None else (n("NFC", r.t), n("NFKC", r.t), n("NFC", r.t).casefold(), n("NFKC", r.t).casefold().replace("i\u0307", "i"))
        assert r[1:] == want


def test_columns_alone_detect_the_same(spark):
    """Rank distances of columns and of batches are the same, and neither form shuffles."""
    rng = random.Random(4)
    words = ["the", "и", "не", "der", "straße", "ўзбек", "və", "را", "ڪتاب", "नमस्ते", "İ", "漢字", "ひらがな", "o'g'li", "1", "!", "ё"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 80))) for _ in range(60)] + ["", "ß", "GMT کې د", "word " * 3000]
    d = spark.createDataFrame([*enumerate(texts), (-1, None)], "doc_id int, text string").coalesce(1)
    whole = dt.in_rows(d, F.col("text"), "d", arrow=False)
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Python" not in plan.replace("ExistingRDD", "")
    columns = {r.doc_id: r.d for r in whole.collect()}
    batches = {r.doc_id: r.d for r in dt.in_rows(d, F.col("text"), "d").collect()}
    want = dict(zip(range(len(texts)), D.detect_all(texts), strict=True))
    assert columns[-1] is None and batches[-1] is None
    for i, w in want.items():
        for got in (columns[i], batches[i]):
            assert (got.script, got.language_code, got.resolution, got.label) == (w["script"], w["language_code"], w["resolution"], w["label"]), texts[i]
            assert abs(got.confidence - w["confidence"]) < 2e-6
            assert [a.language_code for a in got.alternatives] == [a["language_code"] for a in w["alternatives"]] or {a.language_code: round(a.score, 5) for a in got.alternatives} == {a["language_code"]: round(a["score"], 5) for a in w["alternatives"]}
