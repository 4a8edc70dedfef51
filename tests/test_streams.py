"""Counts that stay current on streams are those of all rows at once."""

import shutil

from pyspark.sql import functions as F
from quillspark.operators import evaluate as ev
from quillspark.operators import profiles as pf
from quillspark.streaming.state import RunningCounts, RunningEvaluation, RunningProfiles


def test_profiles_after_a_restart(spark, tmp_path):
    texts = [("en" if i % 2 else "de", i, f"the word{i % 7} and über straße {'na' * (i % 5)}") for i in range(40)] + [("de", 90, None), ("fr", 91, "")]
    docs = spark.createDataFrame(texts, "lang string, doc_id long, text string")
    arriving = str(tmp_path / "in")
    running = RunningProfiles(str(tmp_path / "store"), ["lang"], "doc_id", size=50, every=3)
    for part in range(6):  # a file each, and the stream starts anew for each two of them
        docs.where(F.col("doc_id") % 6 == part).coalesce(1).write.mode("append").parquet(arriving)
        if part % 2:
            running.start(spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(arriving), str(tmp_path / "checkpoint")).awaitTermination()
    want = sorted(map(tuple, pf.build_profiles(docs, ["lang"], size=50, order="doc_id").collect()))
    assert sorted(map(tuple, running.profiles(spark).collect())) == want
    # a batch that comes again counts once: the last of the checkpoint's commits is lost, as if the driver had died before it
    last = max((tmp_path / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    running.start(spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(arriving), str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted(map(tuple, running.profiles(spark).collect())) == want


def test_evaluation_of_batches(spark, tmp_path):
    rows = [(f"c{i}", "en" if i % 3 else "de", "Latn", ("en", "und", "fr")[i % 3], (1, 10)[i % 2], "v" if i % 4 else None, None) for i in range(60)]
    cases = spark.createDataFrame(rows, "id string, expected_language string, script string, guess string, word_count int, variety string, alphabet string")
    detector = lambda df: df.withColumn("detection", F.struct(F.col("guess").alias("code"), F.lit("latin").alias("script")))
    running = RunningEvaluation(str(tmp_path / "store"), detector, every=2)
    for batch in (0, 1, 1, 2, 3, 3, 4):  # some come twice
        running.add(cases.where(F.substring("id", 2, 3).cast("int") % 5 == batch), batch)
    whole = ev.evaluate(cases, detector)
    assert running.totals(spark).collect() == ev.totals(whole).collect()
    order = lambda df: sorted(map(tuple, df.select("grouping", "word_count", "expected_language", "script", "variety", "alphabet", *running.MEASURES).collect()), key=repr)
    assert order(running.breakdown(spark)) == order(ev.breakdown(whole))


def test_a_table_without_its_record_does_not_count(spark, tmp_path):
    store = RunningCounts(str(tmp_path / "s"), ["k"], ["n"], every=2)
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5)], "k string, n long")
    for batch in range(3):
        store.add(rows, batch)
    assert {tuple(r) for r in store.current(spark).collect()} == {("a", 9), ("b", 15)}
    shutil.rmtree(tmp_path / "s-done")
    assert {tuple(r) for r in store.current(spark).collect()} == {("a", 9), ("b", 15)}
