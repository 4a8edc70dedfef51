"""Case sets and samples from archives, treebanks and exports; the evaluator's command line."""

import io
import json
import random
import tarfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from quillspark.functions.transliterate import uyghur_cyrillic
from quillspark.operators import builders as bd
from quillspark.operators import evaluate as ev
from quillspark.operators import sampling as sm
from quillspark.sources import readers, sinks

REGISTRY = "code string, prefix string, language string, language_name string, script string, variety string, min_share double, lexical_only boolean"


def archive(path, members):
    with tarfile.open(path, "w:gz") as out:
        for name, text in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(text.encode())
            out.addfile(info, io.BytesIO(text.encode()))


@pytest.fixture
def lines(spark, tmp_path):
    rng = random.Random(3)
    latin = "\n".join(" ".join(rng.choice(["aba", "42", "cede", "fi", "gogo"]) + f"x{i}" * (k > 0) for k in range(6)) for i in range(50))
    mixed = "\n".join(f"слово{i} ещё раз" if i % 2 else f"word{i} once more" for i in range(50))
    archive(tmp_path / "a.tar.gz", {"./set/devtest/aaa_Latn.devtest": latin + "\n\n", "./set/devtest/bbb_Cyrl.devtest": mixed, "./set/dev/aaa_Latn.dev": "  first e\u0301 \n\nsecond line", "./set/README": "no"})
    return str(tmp_path / "a.tar.gz")


def test_archive(spark, lines):
    dev = readers.read_archive_sentences(spark, lines, "dev").collect()
    assert [tuple(r) for r in dev] == [("aaa_Latn", 1, "first é"), ("aaa_Latn", 2, "second line")]
    got = readers.read_archive_sentences(spark, lines).groupBy("code").count().collect()
    assert {tuple(r) for r in got} == {("aaa_Latn", 50), ("bbb_Cyrl", 50)}


def test_plain_archives_are_read_by_stretches(spark, tmp_path, monkeypatch):
    from quillspark.sources import archives

    for name in "xy":
        with tarfile.open(tmp_path / f"{name}.tar", "w") as out:
            for split in ("dev", "devtest"):
                for k in range(12):
                    text = "".join(f"{name}{k} line {i} e\u0301\r\n\n" for i in range(300)).encode()
                    info = tarfile.TarInfo(f"set/{split}/{name}{k}_Latn.{split}")
                    info.size = len(text)
                    out.addfile(info, io.BytesIO(text))
    index = archives.member_index(spark, str(tmp_path / "*.tar"))
    assert index.count() == 48
    got = archives.read_members(index, ["dev"], ["x1_Latn", "x7_Latn", "y3_Latn", "y11_Latn"], stretch=20_000)
    assert got.select("code", F.spark_partition_id().alias("p")).distinct().select("p").distinct().count() > 2
    assert {tuple(r) for r in got.groupBy("split", "code").agg(F.count(F.lit(1)), F.max("line"), F.max("text")).collect()} == {("dev", f"{n}_Latn", 300, 300, f"{n} line 99 é") for n in ("x1", "x7", "y3", "y11")}
    # bytes: headers alone for the index, and of the members only those that are wanted
    read = []

    class Counting:
        def __init__(self, stream):
            self.stream = stream

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.stream.close()

        def read(self, n=-1):
            data = self.stream.read(n)
            read.append(len(data))
            return data

        def __getattr__(self, name):
            return getattr(self.stream, name)

    opened = archives._open
    monkeypatch.setattr(archives, "_open", lambda path: Counting(opened(path)))
    (rows,) = archives._index(iter([pa.RecordBatch.from_pydict({"archive": [str(tmp_path / "x.tar")]})]))
    whole = (tmp_path / "x.tar").stat().st_size
    assert sum(read) <= 25 * 1024 < whole / 5
    read.clear()
    one = rows.slice(3, 1)
    assert sum(len(b) for b in archives._read(None, None)(iter([one]))) == 300
    assert sum(read) == one.column("size")[0].as_py()


def test_sentence_cases(spark, lines, tmp_path):
    rows = readers.read_archive_sentences(spark, lines)
    registry = spark.createDataFrame([("aaa_Latn", "aa", "aa", "Aa", "Latn", None, None, True), ("bbb_Cyrl", "bb-cyrl", "bb", "Bb", "Cyrl", "North", 0.95, None), ("ccc_Latn", "cc", "cc", "Cc", "Latn", None, None, None)], REGISTRY)
    options = {"lengths": (1, 3, 8), "per_length": 3, "seed": "s"}
    cases = bd.flores_cases(rows, registry, lengths=(1, 3), per_length=3, seed="s")
    found = cases.orderBy("id").collect()
    assert [r.id for r in found] == [f"{p}-{n:03}w-{k:02}" for p in ("aa", "bb-cyrl") for n in (1, 3) for k in (1, 2, 3)]
    assert found == cases.orderBy("id").collect()
    assert all("word" not in r.text and r.variety == "North" and r.expected_language == "bb" for r in found[6:])
    assert all(len(r.text.split()) == r.word_count and r.source.flores_code == "aaa_Latn" for r in found[:6])
    only = bd.flores_cases(rows, registry, only=["aa"], **options).collect()
    # the windows are the words from a place on of the lines without words that hold no letter
    texts = [" ".join(w for w in r.text.split() if any(c.isalpha() for c in w)) for r in sorted(rows.where("code = 'aaa_Latn'").collect(), key=lambda r: r.line)]
    assert len(only) == len({(r.word_count, r.text) for r in only}) == len({r.source.sentence_start for r in only}) == 9
    for r in only:
        run = " ".join(texts[r.source.sentence_start - 1 : r.source.sentence_end]).split()
        k = next(i for i in range(len(texts[r.source.sentence_start - 1].split())) if run[i : i + r.word_count] == r.text.split())
        assert k + r.word_count > len(run) - len(texts[r.source.sentence_end - 1].split())
    both = sm.union_cases(cases, bd.flores_cases(rows, registry, only=["none"]))
    sinks.write_cases(both, str(tmp_path / "cases"))
    assert readers.read_cases(spark, str(tmp_path / "cases")).where("source.flores_code is not null").count() == 12


def test_treebank_and_export(spark, tmp_path):
    (tmp_path / "t.conllu").write_text("".join(f"# sent_id = {i}\n# text_ortho = how far{i} my pipo\n1\thow\n\n# text_ortho =  \n" for i in range(40)))
    sentences = readers.read_conllu_sentences(spark, str(tmp_path / "t.conllu"))
    assert [(r.line, r.text) for r in sentences.orderBy("line").limit(2).collect()] == [(1, "how far0 my pipo"), (2, "how far1 my pipo")]
    registry = spark.createDataFrame([("pcm", "pcm", "pcm", "Nigerian Pidgin", "Latn", None, None, None), ("uzb", "uz-cyrl", "uz", "Uzbek", "Cyrl", "Northern", None, None)], REGISTRY)
    pcm = bd.treebank_cases(sentences, registry, "pcm", "u", "c", lengths=(2, 5), per_length=2).collect()
    assert len(pcm) == 4 and {r.source.dataset for r in pcm} == {"NaijaSynCor"} and all(r.source.sentence_end - r.source.sentence_start <= 2 for r in pcm)
    export = spark.createDataFrame([(900 - 3 * i, "uzb", f"сўз{i} бор эди" if i % 3 else f"lotin{i} bor") for i in range(60)], "sentence_id long, language string, text string")
    uz = bd.export_cases(export, registry, "u", "d", lengths=(2, 5), per_length=2).collect()
    ids = sorted(r.sentence_id for r in export.collect() if "сўз" in r.text)
    texts = {r.sentence_id: r.text for r in export.collect()}
    for r in uz:
        at = ids.index(r.source.sentence_ids[0])
        assert r.source.sentence_ids == ids[at : at + len(r.source.sentence_ids)]
        assert r.text in " ".join(texts[i] for i in r.source.sentence_ids) and r.variety == "Northern"
    assert len(uz) == 4
    (tmp_path / "x.tsv").write_text("1\tuzb\tа")
    with pytest.raises(Exception, match="digest of"):
        bd.export_cases(export, registry, "u", "00", readers.file_digests(spark, str(tmp_path / "x.tsv")))


def test_samples(spark, lines, tmp_path):
    registry = spark.createDataFrame([("aaa_Latn", "sample", "alpha", "A", "Latn", None, None, None), ("bbb_Cyrl", "sample_cyrl", "alpha", "A", "Cyrl", "North", None, None)], REGISTRY)
    found = bd.sentence_samples(readers.read_archive_sentences(spark, lines), registry, words=20)
    assert sorted((r.sample_file, r.sample_word_count, len(r.text.split())) for r in found.collect()) == [("sample", 20, 20), ("sample_cyrl", 20, 20)]
    assert [r.code for r in bd.sentence_samples(readers.read_archive_sentences(spark, lines), registry.where("prefix = 'sample'"), words=20, only=["alpha"]).collect()] == ["aaa_Latn"]
    sinks.write_sample_metadata(found, str(tmp_path / "m"), source="S", license="L")
    (file,) = (tmp_path / "m").rglob("*.json")
    stated = json.loads(file.read_text())
    assert (stated["language"], stated["source"], stated["license"], len(stated["samples"])) == ("alpha", "S", "L", 2)
    assert stated["samples"][1]["variety"] == "North" and "text" not in stated["samples"][0] and stated["retrieved_at"].endswith("+00:00")
    pages = spark.createDataFrame([("u", "<p>چاي چاي</p><p>بار</p>"), ("e", "<p>one two three four</p>")], "code string, html string")
    names = spark.createDataFrame([("u", "sample", "uyghur", "U", "Arab", None, None, None), ("e", "sample", "english", "E", "Latn", None, None, None)], REGISTRY)
    rows = {(r.language, r.sample_file): r.text for r in bd.declaration_samples(pages, names, words=3).collect()}
    assert rows[("english", "sample")] == "one two three" and len(rows) == 4
    arabic = spark.createDataFrame([("چاي چاي\n\nبار",)], "t string")
    assert rows[("uyghur", "sample_cyrillic")] == arabic.select(uyghur_cyrillic(F.col("t"))).first()[0]


def always_english(frame):
    return frame.withColumn("said", F.lit("en"))


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "c.jsonl").write_text("".join(json.dumps({"id": str(i), "expected_language": code, "script": "Latn", "word_count": 3, "text": "the right to freedom"}) + "\n" for i, code in enumerate(["en", "en", "fr"])))
    ours = ev.main(["--cases", str(tmp_path / "c.jsonl")])
    assert ours["totals"].first().exact == 2 and "exact_share" in capsys.readouterr().out
    named = f"{__name__}:always_english"
    tables = ev.main(["--cases", str(tmp_path / "c.jsonl"), "--detector", named, "--column", "said"])
    assert [tuple(r) for r in tables["confusions"].collect()] == [("fr", "en", 1)]
    with pytest.raises(SystemExit):
        ev.main(["--cases", str(tmp_path / "c.jsonl"), "--detector", "nothing"])
