"""The pipeline's stages against brute force, each on what its predecessor kept."""

import random
from collections import Counter

import corpus_pipeline
import pytest
from test_documents_ops import AZ, brute_near, brute_windows, words

KINDS = {"aa": "the and of with ing that have from word there".split(), "bb": "der und nicht ein keit auch werden sich oder".split()}


@pytest.fixture
def folder(spark, tmp_path):
    rng = random.Random(11)
    rows = []
    for i in range(160):
        lang = list(KINDS)[i % 2]
        text = " ".join(rng.choice(KINDS[lang]) + str(rng.randrange(30)) * (rng.random() < 0.5) for _ in range(rng.randint(5, 120)))
        if i % 5 == 4:
            text = rows[rng.randrange(len(rows))][1]
            if i % 2:
                text = text.upper()
            else:
                text = text.replace(" ", " new ", 1)
            lang = None
        rows.append((i * 3, text, lang, f"s{i % 3}" if i % 7 else None, len(text)))
    rows += [(1000, None, None, "s1", 0), (1001, "", "aa", "s1", 0), (1002, "12 34 !!", "aa", "s0", 8), (1003, "word", "aa", "s0", 4)]
    items = [(k, " ".join(words(rows[17 * k][1])[:20])) for k in range(6)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), rows, items


def test_stages(spark, folder, tmp_path):
    path, rows, items = folder
    docs, now = spark.read.parquet(f"{path}/documents.parquet"), {r[0]: r for r in rows}
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, path).write.parquet(f"{path}/out{k}")
        before, docs = now, spark.read.parquet(f"{path}/out{k}")
        if k < 4:
            assert docs.columns == columns
            now = {r.doc_id: tuple(r) for r in docs.collect()}
            assert all(now[i] == before[i] for i in now)
        if name == "language_id":
            assert set(before) - set(now) == {1000, 1001, 1002}
        if name == "exact_dedup":
            last = {}
            for i in sorted(before):
                last[before[i][1].translate(AZ)] = i
            assert set(now) == set(last.values())
        if name == "near_dedup":
            assert set(now) == {c for i, c, n in brute_near(list(before.values()))}
        if name == "decontaminate":
            assert set(now) == {k[0] for k in brute_windows(list(before.values()), items) if not k[2]}
            assert set(before) - set(now)
    got = docs.collect()
    assert docs.columns[: len(columns)] == columns and all(tuple(r)[: len(columns)] == now[r.doc_id] for r in got)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len(now[i][1].split())) for i in now)
    per = {s: sum(r.taken for r in got if r.source == s) for s in {r.source for r in got}}
    goal = {r.source: r.target for r in got}
    assert all(abs(per[s] - goal[s]) <= max(130, 0.05 * goal[s]) for s in per)
    assert all(r.taken <= 3 * r.size for r in got)


def test_run_and_empty(spark, folder, tmp_path):
    path, rows, _ = folder
    assert corpus_pipeline.run(spark, path).count() > 50
    spark.read.parquet(f"{path}/documents.parquet").limit(0).write.parquet(f"{path}/e/documents.parquet")
    spark.read.parquet(f"{path}/benchmark.parquet").limit(0).write.parquet(f"{path}/e/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{path}/e").count() == 0

