"""WARC, quotation links, language ID, token counts and secret scans."""

import gzip
import hashlib
import random
import re
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F
from quillspark.llm import language_id, quote_links, secret_scan, token_counts, warc


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_warc_round_trip(spark, tmp_path, monkeypatch, compression):
    monkeypatch.setattr(warc, "SPLIT_BYTES", 3000)
    big = "é\r\n\r\nWARC/1.1\r\n" * 100
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>" * (i * 7)) for i in range(120)] + [(200, "u", big), (201, "u v\n", big), (202, None, big), (203, "u", None), (204, "u", ""), (205, "u", "x" * 999), (206, "u", "x" * 999), (207, "u", "y" * 200_000)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, payload string").repartition(3)
    path = str(tmp_path / "w")
    warc.write_warc(warc.records(pages), path, compression)
    got = {r.page_id: r for r in warc.read_warc(spark, path).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        body, r = (html or "").encode(), got[i]
        again = i in (200, 201)
        assert (r.record_type, r.refers_to) == (("revisit", 202) if again else ("response", None))
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha1(body).hexdigest())
        assert r.payload is None if again else r.payload == body
    read = warc.read_warc(spark, path, "none")
    some = read.where((F.col("record_type") == "revisit") & F.col("target_uri").startswith("u"))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("PushedFilters", "").split("BatchScan")[0]
    assert sorted(r.page_id for r in some.collect()) == [200, 201]
    assert warc.read_warc(spark, path).where("page_id in (3, 5)").count() == 2
    if compression == "gzip":  # any reader of gzip sees the records
        data = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("*.gz"))
        assert data.count(b"WARC-Type: response") == len(rows) - 2


def test_warc_skips_what_a_predicate_rejects(spark, tmp_path):
    """Bytes unpacked under a predicate on the type: those of the matching records alone."""
    from pyspark.sql.datasource import EqualTo

    body = "".join(random.Random(3).choice("abcdefgh") for _ in range(50_000))
    rows = [(i, "u", body if i % 10 == 0 else f"{i}{body}") for i in range(40)] + [(None, "u", body), (5, "u", body), (5, "u", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_warc(warc.records(pages), str(tmp_path / "w"))
    whole = warc.WarcReader({"path": str(tmp_path / "w"), "payload": "digest"})
    some = warc.WarcReader({"path": str(tmp_path / "w"), "payload": "digest"})
    assert list(some.pushFilters([EqualTo(("record_type",), "revisit")])) == []
    count = {}
    for name, reader in (("all", whole), ("revisits", some)):
        count[name] = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
    assert count == {"all": 43, "revisits": 5}  # pages 0, 10 and 20, one without id, and a repeated id
    assert some.unpacked < 5 * 1000 < whole.unpacked


def test_warc_null_and_repeated_ids(spark, tmp_path, monkeypatch):
    big = "long text " * 200
    rows = [(None, "a", big), (None, "b", None), (7, "c", big), (7, "d", big), (3, "e", big), (4, "f", "x" * 3_000_000), (None, "g", "lone " * 400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    got = []
    for limit in (1 << 20, -1):  # broadcast, and joined by page id
        monkeypatch.setattr(warc, "BROADCAST_BYTES", limit)
        path = str(tmp_path / f"w{limit}")
        warc.write_warc(warc.records(pages), path)
        got.append(Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_warc(spark, path, "digest").collect()))
    want = Counter([(None, "revisit", 7, 2000), (None, "response", None, 0), (7, "response", None, 2000), (7, "response", None, 2000), (3, "revisit", 7, 2000), (4, "response", None, 3_000_000), (None, "response", None, 2000)])
    assert got == [want, want]


def test_warc_empty_and_foreign(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_warc(warc.records(none), str(tmp_path / "e"))
    assert warc.read_warc(spark, str(tmp_path / "e")).count() == 0
    (tmp_path / "f").mkdir()
    (tmp_path / "f/a.warc").write_bytes(b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n" * 3)
    assert [r.record_type for r in warc.read_warc(spark, str(tmp_path / "f")).collect()] == ["warcinfo"] * 3


def test_quote_links(spark):
    rows = [
        ("t", 1, "a", "First para\nsecond line\n\nOther   para"),
        ("t", 2, "b", "> other PARA\n\nMy answer"),
        ("t", 3, "a", ">> Other para\n> My answer\n\nThanks"),
        ("t", 4, "c", "> First para\n> second line\n\nAlso\n>not known\n"),
        ("t", 5, "c", None),
        ("t", 6, "c", ""),
        ("t", 6, "c", ""),
        ("u", 2, "c", "> My answer"),
        (None, 1, "d", "Lone"),
        (None, 2, "d", "> Lone\nYes"),
        ("t", 5000, "e", "> Thanks\n\nLate"),
        ("t", 5001, "e", "> Late\n> \n> Thanks"),
    ]
    m = spark.createDataFrame([(*r, 1) for r in rows], "conv string, n long, role string, text string, parent_id int").repartition(3)
    out = quote_links.reply_order(quote_links.link_quotes(m, "conv", "n"), "conv", "n").collect()
    got = {(r.conv, r.n): (r.parent, r.root, r.depth, r.quoted, r.linked) for r in out}
    assert len(out) == len(rows)
    assert got["t", 1] == (None, 1, 0, 0, 0)
    assert got["t", 2] == (1, 1, 1, 1, 1)
    assert got["t", 3] == (2, 1, 2, 2, 2)
    assert got["t", 4] == (1, 1, 1, 2, 1)
    assert got["t", 5] == (None, 5, 0, 0, 0)
    assert got["u", 2] == (None, 2, 0, 1, 0)
    assert got[None, 2][:3] == (1, 1, 1)
    assert got["t", 5000][:3] == (3, 1, 3)
    assert got["t", 5001][:3] == (5000, 1, 4)
    own = {(r.conv, r.n): r.own for r in out}
    assert own["t", 4] == "Also" and own["t", 3] == "Thanks" and own["t", 5] is None and own["t", 1] == rows[0][3]
    chats = {(r.conv, r.root): [x.text for x in r.messages] for r in quote_links.chats(quote_links.reply_order(quote_links.link_quotes(m, "conv", "n"), "conv", "n"), "conv", "n").collect()}
    assert chats["t", 1] == [rows[0][3], "My answer", "Also", "Thanks", "Late", ""]


def test_quote_links_odd_input(spark):
    """Clashing names, no rows, a hot root, a long text, and a paragraph of very many lines."""
    schema = "conv string, n long, role string, text string, quoted string, parent int, own string, root int, depth int, _t string, _o string"
    long_ = "\n".join(f"line {i}" for i in range(40_000))
    rows = [("a", 0, "r", "Start"), *(("a", i, "r", f"> start\n\nReply {i}") for i in range(1, 1500)), ("b", 1, "r", long_), ("b", 2, "r", "\n".join("> " + x for x in long_.upper().split("\n")) + "\nYes"), ("b", None, "r", "> Yes")]
    m = spark.createDataFrame([(*r, "q", 1, "o", 2, 3, "t", "o") for r in rows], schema).repartition(3)
    out = quote_links.reply_order(quote_links.link_quotes(m, "conv", "n"), "conv", "n")
    got = out.collect()
    assert len(got) == len(rows) and sorted(out.columns) == sorted([*m.columns, "linked"])
    assert {(r.parent, r.root, r.depth) for r in got if r.conv == "a" and r.n} == {(0, 0, 1)}
    assert next(r.parent for r in got if r.conv == "b" and r.n == 2) == 1
    built = quote_links.chats(out, "conv", "n").collect()
    hot = sorted((r for r in built if r.conv == "a"), key=lambda r: r.part)
    assert [len(r.messages) for r in hot] == [256] * 5 + [220] and [x.place for r in hot for x in r.messages] == list(range(1500)) == [x.order for r in hot for x in r.messages]
    none = m.limit(0)
    assert quote_links.chats(quote_links.reply_order(quote_links.link_quotes(none, "conv", "n"), "conv", "n"), "conv", "n").count() == 0


def test_quote_links_against_sql(spark):
    import __spark_entry__
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    got = __spark_entry__.queries()["op4_quote_links"](spark, sf)
    want = con.sql(__spark_entry__.oracle_sql()["op4_quote_links"])
    assert sorted(got.columns) == sorted(want.columns)
    assert Counter(map(tuple, got.select(*want.columns).collect())) == Counter(want.fetchall())


def test_language(spark):
    rng = random.Random(2)
    kinds = {"aa": "the and of with ing".split(), "bb": "der und nicht ein keit".split(), "cc": "les une pour être çon".split()}
    rows = []
    for i in range(300):
        lang = list(kinds)[i % 3]
        rows.append((i, " ".join(rng.choice(kinds[lang]) for _ in range(rng.randint(3, 60))), lang if i % 7 else None, "x"))
    rows += [(1000, None, "aa", "x"), (1001, "123 !!", "bb", "x"), (1002, "", None, "x"), (None, "der und nicht", "bb", "x"), (1003, "les une pour " * 20000, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").repartition(3)
    model = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"))))
    got = {r.doc_id: r for r in language_id.predict(docs, model, keep=["doc_id"]).collect()}
    right = [got[i].lang_pred == list(kinds)[i % 3] for i in range(300)]
    assert sum(right) >= 297
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {got[i].lang_pred for i in (1000, 1001, 1002)} == {"und"} and got[1003].lang_pred == "cc"
    left = language_id.accepted(docs)
    assert left.columns == docs.columns and left.count() == len(rows) - 3
    none = docs.limit(0)
    assert language_id.train(none) is None
    assert language_id.predict(none, model, keep=["doc_id"]).count() == 0 and language_id.accepted(none).count() == 0
    # numerals are no letters
    odd = spark.createDataFrame([(1, "½ ²"), (2, "① Ⅷ _ 9"), (3, "½ x")], "doc_id long, text string")
    assert [r.lang_pred == "und" for r in language_id.predict(odd, model, keep=["doc_id"]).orderBy("doc_id").collect()] == [True, True, False]
    assert [r.lang_pred for r in language_id.predict(docs.limit(2), None).collect()] == ["und"] * 2


def test_kernel_ridge_by_brute_force(spark):
    """Scores against kernel ridge regression written out with sets, all texts being landmarks."""
    import numpy as np

    rng = random.Random(9)
    kinds = {"aa": "the and of with ing".split(), "bb": "der und nicht ein keit".split()}
    texts = [(k, " ".join(rng.choice(kinds[k]) for _ in range(rng.randint(2, 9)))) for k in kinds for _ in range(12)]
    rows = [(i, t, k) for i, (k, t) in enumerate(texts)] + [(0, texts[0][1], "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs)
    flags = np.zeros(language_id.BUCKETS, bool)
    has = lambda t: set(language_id.present(np.frombuffer(t.encode(), np.uint8), flags).tolist())
    sets = [has(t) for _, t in texts]
    kernel = lambda a, b: len(a & b) / np.sqrt(len(a) * len(b))
    gram = np.array([[kernel(a, b) for b in sets] for a in sets])
    y = np.array([[float(k == name) for name in kinds] for k, _ in texts])
    # centred kernel ridge in its dual form
    n = len(texts)
    centre = np.eye(n) - 1 / n
    alpha = np.linalg.solve(centre @ gram @ centre + language_id.RIDGE * np.eye(n), centre @ y)
    new = ["the and of ing", "der keit und", "with nicht", "of"]
    got = {r.doc_id: r for r in language_id.predict(spark.createDataFrame(list(enumerate(new)), "doc_id long, text string"), model, keep=["doc_id"]).collect()}
    for i, t in enumerate(new):
        row = np.array([kernel(has(t), b) for b in sets])
        want = (row - gram.mean(axis=0)) @ centre @ alpha + y.mean(axis=0)
        assert got[i].lang_pred == list(kinds)[int(want.argmax())]
        assert got[i].score == pytest.approx(min(max(want.max(), 0), 1), abs=2e-3)


def test_unseen_language_is_rejected(spark):
    rng = random.Random(4)
    kinds = {"aa": "the and of with ing".split(), "bb": "der und nicht ein keit".split(), "cc": "les une pour être çon".split(), "dd": "los que para con del".split()}
    rows = [(i, " ".join(rng.choice(kinds[lang]) for _ in range(rng.randint(3, 60))), lang, "x") for i in range(300) for lang in [list(kinds)[i % 4]]]
    strange = [(1000, "Все люди рождаются свободными и равными", None, "x"), (1001, "szyby wyłączyć gżegżółka myśmy", None, "x"), (1002, "ᚠᛇᚻ ᛒᛦᚦ ᚠᚱᚩᚠᚢᚱ " * 300, None, "x")]
    docs = spark.createDataFrame(rows + strange, "doc_id long, text string, lang string, score string").repartition(3)
    assert {r.doc_id for r in language_id.accepted(docs).collect()} == set(range(300))
    # a long text in all of the languages, one after the other, is in no strange one
    long_ = " ".join(" ".join(rng.choice(kinds[lang]) for _ in range(2500)) for lang in kinds)
    both = docs.unionByName(spark.createDataFrame([(2000, long_, None, "x"), (2001, strange[0][1] * 500, None, "x")], docs.schema))
    assert {r.doc_id for r in language_id.accepted(both).collect()} == {*range(300), 2000}
    # one label, or one text of a label: nothing to compare with, and clean texts stay
    few = spark.createDataFrame([r for r in rows if r[2] == "aa"] + rows[1:2] + strange, docs.schema)
    left = {r.doc_id for r in language_id.accepted(few).collect()}
    assert {r[0] for r in rows if r[2] == "aa"} <= left and not left & {1000, 1002}


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    import __spark_entry__

    got = __spark_entry__.queries()["op6_language_id"](spark, "/root/testdata/sf0.01")
    hit = got.where("held_out").join(docs.select("doc_id", "lang"), "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert hit > 0.99


def greedy(symbols, pieces):
    n = i = 0
    while i < len(symbols):
        for j in range(len(symbols), i, -1):
            if symbols[i:j] in pieces:
                break
        else:
            if symbols[i:] == (256,):
                return n
            return None
        n, i = n + 1, j
    return n


def test_token_automaton():
    rng = random.Random(1)
    for _ in range(200):
        pieces = {tuple(rng.choice(b"abc") for _ in range(rng.randint(1, 5))) + ((256,) if rng.random() < 0.3 else ()) for _ in range(rng.randint(1, 12))}
        automaton = token_counts.Automaton(sorted(pieces))
        for _ in range(60):
            word = (*(rng.choice(b"abcd") for _ in range(rng.randint(0, 9))), 256)
            assert automaton.count(word) == greedy(word, pieces), (pieces, word)


def test_token_counts(spark):
    pieces = set(token_counts.load_pieces(token_counts.VOCABULARY))
    rows = [(1, "The Éléphant's 12 tréés!!"), (2, None), (3, ""), (4, " \n"), (5, "a" * 5000), (6, "日本 x_y"), (6, "日本 x_y"), (None, "the the")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_tokens int")
    want = []
    for i, t in rows:
        found = token_counts.SPLIT.findall((t or "").lower())
        want.append((i, len(found), sum(greedy((*w.encode(), 256), pieces) for w in found)))
    assert Counter(map(tuple, token_counts.token_counts(docs).collect())) == Counter(want)


def brute_spans(text):
    out = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def test_secrets(spark):
    rng = random.Random(4)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    upper = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(n))
    mixed = lambda: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(32))
    rows = [(i, f"é words thatareverylong {rng.choice(['token', 'API_KEY', 'Secret', 'passwd'])} = \"{mixed()}\" and AKIA{upper(16)} {hexes(40)} end{i}") for i in range(80)]
    rows += [(100, None), (101, ""), (102, "tokenK = 'abcdefghijkl' toKen:abcdefghijklm"), (103, "AKIA" * 6), (104, f"xx {mixed()} yy"), (105, "plainwordsonlyhere anotherplainword " * 50), (106, "token=short secret=password=longenoughvalue")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, spans int").repartition(2)
    got = {r.doc_id: r for r in secret_scan.secret_scan(docs).collect()}
    for i, text in rows:
        base = brute_spans(text or "")
        listed = [f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in base]
        assert got[i].base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest(), (i, got[i].spans, listed)
        assert [x for x in got[i].spans.split(",") if x and not x.startswith("format")] == listed
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(s[1] == k for s in base) for k in range(3))
    assert got[105].spans == "" and got[104].n_format == 1
    assert secret_scan.secret_scan(docs.limit(0)).count() == 0


def test_formats_on_withheld_credentials():
    """Precision and recall over credentials that were not learnt; addresses, words and hosts are none."""
    rng = random.Random(6)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    key = lambda: "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
    word = lambda: "".join(rng.choice(["tion", "ing", "the", "er", "heit", "que", "on"]) for _ in range(rng.randint(4, 8))).ljust(12, "s")
    formats = secret_scan.Formats({"assign": [hexes(40) for _ in range(200)], "access": [key() for _ in range(200)], "hex": [hexes(16)] * 3}, [word() for _ in range(600)])
    assert formats.skipped == {"hex": 3}
    other = [word() for _ in range(2000)] + [".".join(str(rng.randrange(100, 256)) for _ in range(4)) for _ in range(200)] + ["mail7.example.com", "2024-01-31T10.00", "/usr/local/share/x"]
    for credentials in ([hexes(40) for _ in range(300)], [key() for _ in range(300)]):
        found = secret_scan.assess(formats, credentials, other)
        assert found["recall"] >= 0.95 and found["precision"] >= 0.99 and found["false_rate"] <= 0.001, found
    assert formats.is_secret(key()) and not formats.is_secret(key()[:13])
    assert not formats.is_secret(key() * 3)


def test_candidates_around_base_spans():
    text = "host/deadbeefdeadbeef/longtailofletters xdeadbeefdeadbeefx"
    assert [text[a:b] for a, b in secret_scan.candidates(text, secret_scan.base_spans(text))] == ["/longtailofletters"]
    assert secret_scan.candidates("a" * 11 + " " + "b.c" * 4, []) == [(12, 24)]


def test_secrets_long_text(spark):
    text = "words and " * 60_000 + 'token = "' + "0f" * 20 + '" ' + "x" * 300_000
    docs = spark.createDataFrame([(1, text), (2, text), (3, "plain")], "doc_id long, text string")
    got = {r.doc_id: r for r in secret_scan.secret_scan(docs).collect()}
    assert got[1].n_assign == got[2].n_assign == 1 and got[1].n_hex == 1 and got[3].spans == ""


def test_merged_automaton_by_hand():
    """Ten times "a", ten times "b" and an alphabet of two: states behind a and b are alike and merge; the score is the smoothed product."""
    import math

    automaton = secret_scan.Automaton(["a"] * 10 + ["b"] * 10)
    assert automaton.moves[0]["a"] == automaton.moves[0]["b"]
    start, end = 20 + 35.5, automaton.passed[automaton.moves[0]["a"]] + 35.5
    assert automaton.score("a") == pytest.approx(math.log2(10.5 / start) + math.log2((automaton.passed[automaton.moves[0]["a"]] + 0.5) / end))


def test_pdfa_learns_a_loop():
    words = ["ab" * n for n in range(1, 40)]
    automaton = secret_scan.Automaton(words)
    assert automaton.score("ab" * 60) > automaton.score("aab" * 40) + 50
