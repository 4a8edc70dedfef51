"""DuckDB SQL for the registered queries, put together from common table expressions.

The tables' texts hold Latin letters only and no character that normalisation changes but for
case and ß, so SQL's lower() with that one replacement is the engine's normalisation here.
"""

from __future__ import annotations

from ..functions import charsets
from ..operators.corpus import DIAGNOSTIC
from ..operators.profiles import load_profiles
from ..resources import fixed


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strings(items) -> str:
    return "[" + ", ".join(map(quote, items)) + "]"


NORM = "norm AS (SELECT doc_id, lang, text, replace(lower(text), 'ß', 'ss') AS norm FROM documents)"
FOLD = f"translate(norm, {quote(fixed.APOSTROPHES)}, {quote(chr(39) * len(fixed.APOSTROPHES))})"
TOKENS = f"tok AS (SELECT doc_id, lang, norm, regexp_extract_all({FOLD}, {quote(charsets.token_pattern())}) AS w FROM norm)"
WORDS = "words AS (SELECT doc_id, word, count(*) AS cnt, min(pos) AS first FROM (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM tok) GROUP BY ALL)"
CUT = "flatten([[substring('^' || word || '$', CAST(i AS INT), CAST(n AS INT)) for i in range(1, length(word) + 4 - n)] for n in [2, 3, 4]])"
GRAMS = f"grams AS (SELECT doc_id, g AS ngram, sum(cnt) AS cnt, min(first * 1000000 + off) AS fo FROM (SELECT doc_id, cnt, first, unnest(gs) AS g, unnest(range(len(gs))) AS off FROM (SELECT *, {CUT} AS gs FROM words)) GROUP BY ALL)"
TOP = "top AS (SELECT doc_id, ngram, CAST(cnt AS BIGINT) AS cnt, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cnt DESC, fo) - 1 AS rank FROM grams) WHERE rank < 300)"


def count_of(script: str, text: str = "norm") -> str:
    return f"CAST(len(regexp_extract_all({text}, {quote(charsets.char_class(script))})) AS BIGINT)"


def letter_counts() -> str:
    raw = ", ".join(f"{count_of(s)} AS {s}" for s in charsets.SCRIPTS)
    fixed_up = {"Jpan": "CASE WHEN Jpan > 0 THEN Jpan + Hani ELSE 0 END", "Hani": "CASE WHEN Jpan > 0 THEN 0 ELSE Hani END"}
    return f"raw AS (SELECT doc_id, {raw} FROM norm), lc AS (SELECT doc_id, {', '.join(f'{fixed_up.get(s, s)} AS {s}' for s in charsets.SCRIPTS)} FROM raw)"


def dominant() -> str:
    """Without ties: the tables have one script."""
    total = " + ".join(charsets.SCRIPTS)
    most = f"greatest({', '.join(charsets.SCRIPTS)})"
    which = "CASE " + " ".join(f"WHEN {s} = {most} THEN '{s}'" for s in charsets.SCRIPTS) + " END"
    return f"dom AS (SELECT doc_id, CASE WHEN {total} > 0 THEN {which} END AS script, CASE WHEN {total} > 0 THEN {most} END AS n_script, {most} / nullif({total}, 0) AS script_share FROM lc)"


def dominant_by_order() -> str:
    """With ties: the most letters, then any script but Latin, then the one whose letter comes first."""
    each = " UNION ALL ".join(
        f"SELECT doc_id, '{s}' AS script, {s} AS n, '{s}' <> 'Latn' AS other, (SELECT min(instr(norm, c)) FROM (SELECT unnest(regexp_extract_all(norm, {quote(charsets.char_class(s) if s != 'Jpan' else charsets.char_class('Jpan')[:-1] + charsets.char_class('Hani')[1:])})) AS c)) AS first FROM lc JOIN norm USING (doc_id) WHERE {s} > 0"
        for s in charsets.SCRIPTS
    )
    return f"each_script AS ({each}), dom AS (SELECT d.doc_id, b.script FROM norm d LEFT JOIN (SELECT doc_id, first(script ORDER BY n DESC, other DESC, first) AS script FROM each_script GROUP BY doc_id) b USING (doc_id))"


def cues() -> str:
    unique = fixed.unique_cues()
    parts = [f"SELECT {quote(k)} AS language_code, unnest({strings(dict.fromkeys(ws))}) AS word, unnest({[w in unique[k] for w in dict.fromkeys(ws)]!s}) AS is_unique" for k, ws in fixed.CUES.items()]
    table = "cues AS (" + " UNION ALL ".join(parts) + ")"
    return f"{table}, cue AS (SELECT doc_id, language_code, CAST(sum(least(cnt, 3)) AS BIGINT) AS cue_sum, CAST(sum(CASE WHEN is_unique THEN least(cnt, 3) ELSE 0 END) AS BIGINT) AS unique_sum FROM words JOIN cues USING (word) GROUP BY ALL)"


def letters() -> str:
    rows = [f"({quote(k)}, {quote(c)}, {w})" for k, ws in fixed.DISTINCTIVE.items() for c, w in ws.items()]
    return f"dl(language_code, ch, w) AS (VALUES {', '.join(rows)}), dist AS (SELECT doc_id, language_code, sum((length(norm) - length(replace(norm, ch, ''))) * w) AS weight FROM norm, dl GROUP BY ALL)"


def distances() -> str:
    """Profiles of the Latin script, ranks as lists."""
    mine = [p for p in load_profiles() if p["script"] == "Latn"]
    parts = [f"SELECT {p['order']} AS p, {quote(p['language_code'])} AS language_code, unnest({strings(p['ngrams'])}) AS ngram, unnest(range({len(p['ngrams'])})) AS r" for p in mine]
    sizes = ", ".join(f"({p['order']}, {quote(p['language_code'])}, {len(p['ngrams'])})" for p in mine)
    return (
        f"prof AS ({' UNION ALL '.join(parts)}), sizes(p, language_code, n) AS (VALUES {sizes}), "
        "m AS (SELECT doc_id, count(*) AS m FROM top GROUP BY doc_id), "
        "away AS (SELECT t.doc_id, s.p, s.language_code, sum(abs(t.rank - coalesce(prof.r, s.n))) / (any_value(m.m) * any_value(s.n)) AS d "
        "FROM top t JOIN m USING (doc_id) JOIN dom USING (doc_id) CROSS JOIN sizes s LEFT JOIN prof ON prof.p = s.p AND prof.ngram = t.ngram WHERE dom.script = 'Latn' GROUP BY t.doc_id, s.p, s.language_code), "
        "far AS (SELECT doc_id, language_code, min(d) AS distance FROM away GROUP BY ALL)"
    )


def scored() -> str:
    order: dict[str, int] = {}
    for p in load_profiles():
        if p["script"] == "Latn":
            order.setdefault(p["language_code"], p["order"])
    values = ", ".join(f"({quote(k)}, {o})" for k, o in order.items())
    return (
        f"lang(language_code, o) AS (VALUES {values}), "
        "nw AS (SELECT doc_id, len(w) AS n_words FROM tok), "
        "feat AS (SELECT d.doc_id, d.n_script, d.script_share, n_words, lang.language_code, lang.o, coalesce(distance, 1.0) AS distance, coalesce(weight, 0) / sqrt(greatest(1, n_script)) AS letters, "
        "coalesce(cue_sum, 0) / sqrt(greatest(1, n_words)) AS cue, coalesce(unique_sum, 0) / sqrt(greatest(1, n_words)) AS uniq "
        "FROM dom d JOIN nw USING (doc_id) CROSS JOIN lang LEFT JOIN far ON far.doc_id = d.doc_id AND far.language_code = lang.language_code "
        "LEFT JOIN dist ON dist.doc_id = d.doc_id AND dist.language_code = lang.language_code LEFT JOIN cue ON cue.doc_id = d.doc_id AND cue.language_code = lang.language_code WHERE d.script = 'Latn'), "
        "raw2 AS (SELECT *, -7 * distance + 1.25 * letters + 0.9 * cue + CASE WHEN n_words = 1 THEN 5 * uniq ELSE 0 END AS raw FROM feat), "
        "ex AS (SELECT *, exp(raw - max(raw) OVER (PARTITION BY doc_id)) AS e FROM raw2), "
        "soft AS (SELECT *, round_even(e / sum(e) OVER (PARTITION BY doc_id), 6) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY e DESC, o) AS k FROM ex), "
        "two AS (SELECT a.*, a.score - coalesce(b.score, 0) AS margin FROM soft a LEFT JOIN soft b ON b.doc_id = a.doc_id AND b.k = 2 WHERE a.k = 1), "
        "ok AS (SELECT *, ((CASE WHEN script_share < 0.7 THEN false "
        "WHEN n_script <= 2 THEN (letters >= 2.5 AND score >= 0.8) OR (cue >= 0.9 AND score >= 0.85) "
        "WHEN n_words <= 1 THEN (score >= 0.93 AND margin >= 0.6) OR (letters >= 1 AND score >= 0.55) OR (cue >= 0.9 AND score >= 0.7) "
        "WHEN n_words <= 3 THEN score >= 0.66 AND margin >= 0.2 WHEN n_words >= 1000 THEN score >= 0.2 AND margin >= 0.1 ELSE score >= 0.3 AND margin >= 0.05 END) "
        "OR (n_words <= 3 AND uniq >= 0.5 AND score >= 0.3 AND margin >= 0.1)) AND (language_code <> 'pcm' OR letters > 0 OR uniq > 0) AS resolved FROM two)"
    )


def names() -> str:
    return "CASE code " + " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in fixed.LANGUAGE_NAMES.items()) + " END"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def sample_letters() -> str:
    return with_(
        f"ch AS (SELECT lang AS sample, unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), {quote(charsets.char_class('letter'))})) AS char FROM documents), "
        "letters AS (SELECT sample, char, count(*) AS n FROM ch GROUP BY ALL)"
    )


def respelled(alphabets: list[tuple[str, str]]) -> str:
    """Documents in other alphabets, by id."""
    cases = " ".join(f"WHEN {i} THEN translate(lower(text), {quote(a)}, {quote(b)})" for i, (a, b) in enumerate(alphabets))
    return f"resp AS (SELECT doc_id, printf('alphabet %02d', doc_id % {len(alphabets)}) AS lang, CASE doc_id % {len(alphabets)} {cases} END AS text FROM documents)"


def script_cuts(alphabets: list[tuple[str, str]]) -> str:
    """Letters with their scripts in texts of three alphabets, place by place; a change is a letter whose script is not that of the one before."""
    n = len(alphabets)
    spell = lambda text, shift: f"CASE (doc_id + {shift}) % {n} " + " ".join(f"WHEN {i} THEN translate({text}, {quote(a)}, {quote(b)})" for i, (a, b) in enumerate(alphabets)) + " END"
    script = "CASE " + " ".join(f"WHEN regexp_matches(c, {quote(charsets.char_class(s))}) THEN '{s}'" for s in charsets.SCRIPTS) + " END"
    return (
        f"WITH parts AS (SELECT doc_id, lower(text) AS t, length(text) // 3 AS n FROM documents), "
        f"resp AS (SELECT doc_id, {spell('substring(t, 1, n)', 0)} || {spell('substring(t, n + 1, n)', 5)} || {spell('substring(t, 2 * n + 1)', 10)} AS text FROM parts), "
        "chars AS (SELECT doc_id, unnest(string_split(text, '')) AS c, unnest(range(length(text))) AS i FROM resp), "
        f"kinds AS (SELECT c, {script} AS script FROM (SELECT DISTINCT c FROM chars)), "
        "letters AS (SELECT doc_id, i, CASE WHEN script = 'Hani' AND bool_or(script = 'Jpan') OVER (PARTITION BY doc_id) THEN 'Jpan' ELSE script END AS script FROM chars JOIN kinds USING (c) WHERE script IS NOT NULL), "
        "turns AS (SELECT *, lag(script) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM letters), "
        "cuts AS (SELECT doc_id, string_agg(i::VARCHAR, ' ' ORDER BY i) FILTER (before IS NOT NULL) AS cuts, string_agg(script, ' ' ORDER BY i) AS scripts FROM turns WHERE before IS DISTINCT FROM script GROUP BY doc_id) "
        "SELECT doc_id, coalesce(cuts, '') AS cuts, coalesce(scripts, '') AS scripts FROM documents LEFT JOIN cuts USING (doc_id)"
    )


def windows() -> str:
    """Every line's window, drawn by MD5, cut from its key's words; those that hold what is asked are taken by draw."""
    draw = lambda *parts: f"('0x' || substring(md5('cases:' || key || ':' || nth{''.join(parts)}), 1, 8))::BIGINT"
    letter = quote(charsets.char_class("letter"))
    return (
        "WITH lines AS (SELECT printf('d%06d', doc_id // 250) AS key, doc_id AS line, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS ws FROM documents), "
        "held AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY line) AS nth, coalesce(sum(len(ws)) OVER (PARTITION BY key ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM lines WHERE len(ws) > 0), "
        f"draws AS (SELECT *, {draw()} AS h, {draw(chr(32) + '||' + chr(32) + quote(':word:') + ' || j')} AS h2 FROM held, (SELECT unnest(range(4)) AS j)), "
        "starts AS (SELECT *, [1, 2, 3, 5, 10, 20, 50, 100][(dense_rank() OVER (PARTITION BY key ORDER BY h, nth) - 1) % 8 + 1] AS n, before + h2 % len(ws) AS a FROM draws), "
        "whole AS (SELECT key, flatten(list(ws ORDER BY nth)) AS ws, flatten(list(list_transform(ws, lambda w: nth) ORDER BY nth)) AS nths FROM held GROUP BY key), "
        "cut AS (SELECT s.key, s.nth, s.h, s.j, s.n, w.ws[s.a + 1:s.a + s.n] AS ws, w.nths[s.a + s.n] AS line_end FROM starts s JOIN whole w USING (key)), "
        f"good AS (SELECT *, array_to_string(ws, ' ') AS text FROM cut WHERE len(ws) = n AND len(list_filter(ws, lambda w: regexp_matches(w, {letter}))) = n), "
        "texts AS (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY key, n, text ORDER BY h, nth, j) = 1), "
        "once AS (SELECT * FROM texts QUALIFY row_number() OVER (PARTITION BY key, nth ORDER BY h, nth, j) = 1), "
        "taken AS (SELECT *, row_number() OVER (PARTITION BY key, n ORDER BY h, nth) AS number FROM once QUALIFY number <= 5) "
        "SELECT key, n AS word_count, number, text, nth AS line_start, line_end, printf('doc-%03dw-%02d', n, number) AS id FROM taken"
    )


def case_checks() -> str:
    before = "coalesce(lag(line_end) OVER (PARTITION BY key ORDER BY line_start, line_end), 0)"
    return (
        f"WITH c AS ({windows()}) SELECT 'buckets' AS \"check\", count(*) AS n FROM (SELECT key, word_count FROM c GROUP BY ALL HAVING count(*) <> 5) "
        f"UNION ALL SELECT 'overlaps', count(*) FROM (SELECT line_start <= {before} AS bad FROM c) WHERE bad "
        "UNION ALL SELECT 'texts', count(*) FROM (SELECT text FROM c GROUP BY text HAVING count(*) > 1)"
    )


def predictions(shapes: tuple[str, ...]) -> str:
    """The first key that an object has counts, whatever its value; strings and lists count by themselves."""
    known = lambda table, x: "CASE " + x + " " + " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in table.items()) + " END"
    first = lambda names: "CASE " + " ".join(f"WHEN list_contains(json_keys(j), '{n}') THEN j->>'{n}'" for n in names) + " END"
    alias = lambda x: f"coalesce({known(fixed.SCRIPT_ALIASES, f'lower(trim({x}))')}, {x})"
    language = lambda x: f"CASE WHEN lower(trim({x})) NOT IN ('', 'und', 'unknown', 'uncertain') THEN lower(trim({x})) END"
    bare = known(fixed.SCRIPT_ALIASES, "lower(trim(j->>'$'))")
    cases = " ".join(f"WHEN {i} THEN {quote(x)}" for i, x in enumerate(shapes))
    object_ = f"CASE WHEN json_type(j) = 'OBJECT' THEN {first(('language_code', 'language', 'code'))} END", f"CASE WHEN json_type(j) = 'OBJECT' THEN {first(('script', 'alphabet', 'script_code'))} END"
    return (
        f"WITH p AS (SELECT doc_id, CAST(replace(CASE doc_id % {len(shapes)} {cases} END, '%s', lang) AS JSON) AS j FROM documents), "
        f"o AS (SELECT doc_id, j, {object_[0]} AS ol, {object_[1]} AS os FROM p), "
        f"r AS (SELECT doc_id, CASE json_type(j) WHEN 'VARCHAR' THEN CASE WHEN {bare} IS NULL THEN j->>'$' END WHEN 'ARRAY' THEN j->>'$[0]' ELSE ol END AS l, CASE json_type(j) WHEN 'VARCHAR' THEN {bare} WHEN 'OBJECT' THEN os END AS s, ol, os FROM o), "
        f"n AS (SELECT doc_id, {language('l')} AS language, {alias('s')} AS script, {language('ol')} AS map_language, {alias('os')} AS map_script FROM r) "
        f"SELECT doc_id, language, coalesce(script, {known(fixed.LANGUAGE_SCRIPTS, 'language')}) AS script, map_language, coalesce(map_script, {known(fixed.LANGUAGE_SCRIPTS, 'map_language')}) AS map_script FROM n"
    )


def composed(marked: dict[str, str]) -> str:
    text = "text"
    for c, d in marked.items():
        text = f"replace({text}, {quote(c)}, {quote(d)})"
    return f"SELECT doc_id, sha256(nfc_normalize(t)) AS nfc_sha256, length(t) - length(nfc_normalize(t)) AS saved FROM (SELECT doc_id, {text} AS t FROM documents)"


def clauses() -> str:
    """Boundaries of the turns' clauses: their texts hold one script, so clauses alone cut them. Runs of
    the dividing marks and of what is between them are taken in turn, and their lengths added up."""
    # fixed values: what ends a clause
    mark = r"(?:\r\n|\r|\n|[.!?;:]+)[\t \f\v]*"
    return (
        f"bit AS (SELECT conv_id, turn, text, regexp_extract_all(text, {quote(mark + '|[^' + chr(92) + 'r' + chr(92) + 'n.!?;:]+')}) AS bits FROM conversations), "
        "acc AS (SELECT conv_id, turn, text, [list_sum([length(y) for y in bits[1:i]]) for i in range(1, len(bits) + 1) if regexp_matches(bits[i], '^[\\r\\n.!?;:]')] AS ends FROM bit)"
    )


def spans(detection: str) -> str:
    """Spans of the turns and what each is detected as: clauses are detected, those without a script join the one
    before or the first with one, equal neighbours are one span, and spans are detected on their whole text.

    ``detection`` is the SQL of detecting ``documents``; each use has its own table in that place.
    """
    over = "OVER (PARTITION BY conv_id, turn ORDER BY s"
    of = lambda rows: f"({detection.replace('FROM documents)', f'FROM {rows})')} SELECT * FROM res)"
    return (
        f"{clauses()}, cut AS (SELECT conv_id, turn, text, list_sort(list_distinct(list_concat([0, length(text)], [CAST(e AS BIGINT) for e in ends]))) AS c FROM acc), "
        "bounds AS (SELECT conv_id, turn, c[i] AS s, c[i + 1] AS e, substring(text, c[i] + 1, c[i + 1] - c[i]) AS text FROM (SELECT *, unnest(range(1, len(c))) AS i FROM cut)), "
        "pieces AS MATERIALIZED (SELECT row_number() OVER (ORDER BY conv_id, turn, s) AS doc_id, CAST(NULL AS VARCHAR) AS lang, * FROM bounds), "
        f"found_piece AS {of('pieces')}, "
        "marks AS (SELECT p.*, script || '/' || coalesce(language_code, '') AS mark FROM pieces p JOIN found_piece USING (doc_id)), "
        f"filled AS (SELECT * REPLACE (coalesce(last_value(mark IGNORE NULLS) {over} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(mark IGNORE NULLS) {over} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS mark) FROM marks), "
        f"changes AS (SELECT *, row_number() {over}) > 1 AND mark IS DISTINCT FROM lag(mark) {over}) AS new FROM filled), "
        f"islands AS (SELECT *, sum(CAST(new AS INT)) {over}) AS island FROM changes), "
        "joined AS (SELECT conv_id, turn, min(s) AS s, max(e) AS e, string_agg(text, '' ORDER BY s) AS text FROM islands GROUP BY conv_id, turn, island), "
        "span AS MATERIALIZED (SELECT row_number() OVER (ORDER BY conv_id, turn, s) AS doc_id, CAST(NULL AS VARCHAR) AS lang, * FROM joined), "
        f"span_res AS MATERIALIZED (SELECT span.conv_id, span.turn, s, e, r.* FROM span JOIN {of('span')} r USING (doc_id)), "
        "whole AS MATERIALIZED (SELECT row_number() OVER (ORDER BY conv_id, turn) AS doc_id, CAST(NULL AS VARCHAR) AS lang, conv_id, turn, text FROM conversations), "
        f"whole_res AS (SELECT whole.conv_id, whole.turn, r.* FROM whole JOIN {of('whole')} r USING (doc_id))"
    )


def summary() -> str:
    """A row for each turn, from its spans and its whole text."""
    return (
        "codes AS (SELECT conv_id, turn, string_agg(language_code, ' ' ORDER BY s) AS languages, count(*) AS n_languages FROM (SELECT conv_id, turn, language_code, min(s) AS s FROM span_res WHERE language_code IS NOT NULL GROUP BY ALL) GROUP BY ALL), "
        "counts AS (SELECT conv_id, turn, count(*) AS n_spans, count(DISTINCT script) AS n_scripts, bool_or(language_code IS NULL) AS open FROM span_res GROUP BY ALL) "
        "SELECT conv_id, turn, language_code, coalesce(n_spans, 0) AS n_spans, coalesce(languages, '') AS languages, coalesce(n_scripts, 0) > 1 AS is_mixed_script, coalesce(n_languages, 0) > 1 AS is_mixed_language, "
        "coalesce(n_scripts, 0) > 1 OR coalesce(n_languages, 0) > 1 AS is_mixed, coalesce(open, false) AS has_unresolved_segments "
        "FROM whole_res LEFT JOIN counts USING (conv_id, turn) LEFT JOIN codes USING (conv_id, turn)"
    )


def uyghur(letters: str) -> str:
    """Texts in three alphabets: each letter by itself, then the Cyrillic pairs."""
    out = []
    for column in (1, 2, 3):
        now = f"translate(lower(text), {quote(letters)}, {quote(''.join(r[0] for r in fixed.UYGHUR))})"
        for row in fixed.UYGHUR:
            now = f"replace({now}, {quote(row[0])}, {quote(row[column])})"
        if column == 2:
            for pair, one in (("йа", "я"), ("йу", "ю"), ("йо", "ё")):
                now = f"replace({now}, {quote(pair)}, {quote(one)})"
        out.append(now)
    return f"SELECT doc_id, sha256({out[0]}) AS latin, sha256({out[1]}) AS cyrillic, sha256({out[2]}) AS new_script FROM documents"


def statements(alphabets: list[tuple[str, str]], letters_for_uyghur: str, marked: dict[str, str], shapes: tuple[str, ...]) -> dict[str, str]:
    base = (NORM, TOKENS, WORDS)
    full = (*base, GRAMS, TOP, letter_counts(), dominant(), cues(), letters(), distances(), scored())
    result = with_(
        *full,
        f"found AS (SELECT d.doc_id, d.script, CASE WHEN resolved THEN language_code END AS code, CASE WHEN d.script IS NULL THEN 0 WHEN resolved THEN score * d.script_share ELSE d.script_share END AS conf FROM dom d LEFT JOIN ok USING (doc_id)), "
        f"res AS (SELECT doc_id, script, code AS language_code, round_even(conf, 6) AS confidence, CASE WHEN code IS NOT NULL THEN 'language' WHEN script IS NOT NULL THEN 'script' ELSE 'none' END AS resolution, "
        f"CASE WHEN script IS NULL THEN 'Unknown script' ELSE 'Latin' END || ' · ' || coalesce({names()}, 'uncertain') AS label FROM found)",
    )
    words_of = "list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')"
    case = (
        f"SELECT d.doc_id, lang AS expected_language, 'Latn' AS script, source AS variety, CASE WHEN d.doc_id % 2 = 0 THEN 'even' END AS alphabet, "
        f"CASE WHEN len({words_of}) < 100 THEN 10 WHEN len({words_of}) < 1000 THEN 100 ELSE 1000 END AS word_count, res.language_code AS predicted, res.script AS predicted_script FROM documents d JOIN res USING (doc_id)"
    )
    rows = f", ev AS (SELECT *, coalesce(predicted = expected_language, false) AS lc, coalesce(predicted_script = script, false) AS sc FROM ({case})), evr AS (SELECT *, CASE WHEN lc AND sc THEN 'language' WHEN predicted IS NULL AND sc THEN 'script' ELSE 'wrong' END AS resolution FROM ev) "
    measures = "count(*) AS cases, count(*) FILTER (resolution = 'language') AS exact, count(*) FILTER (resolution = 'script') AS script_only, count(*) FILTER (resolution = 'wrong') AS wrong, count(predicted) AS attempted, count(*) FILTER (lc) AS language_correct, count(*) FILTER (sc) AS script_correct"
    pct = lambda a, b: f"CASE WHEN {b} = 0 THEN 'n/a' ELSE printf('%.1f%%', 100.0 * ({a}) / {b}) END"
    sets = []
    for name, cols in (("word_count", ["word_count"]), ("expected_language", ["expected_language"]), ("expected_language/script", ["expected_language", "script"]), ("expected_language/variety", ["expected_language", "variety"]), ("expected_language/alphabet", ["expected_language", "alphabet"])):
        every = [f"{c}" if c in cols else f"NULL AS {c}" for c in ("word_count", "expected_language", "script", "variety", "alphabet")]
        sets.append(f"SELECT '{name}' AS grouping, {', '.join(every)}, {measures} FROM evr WHERE {' AND '.join(f'{c} IS NOT NULL' for c in cols)} GROUP BY {', '.join(cols)}")
    ranked = lambda source, value, k: f"SELECT sample, {value}, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY n DESC, {value}) AS rank FROM {source}) WHERE rank <= {k}"
    sample_tokens = with_(NORM, TOKENS)
    other = "CASE " + " ".join(f"WHEN regexp_matches(char, {quote(charsets.char_class(s))}) THEN {quote('Japanese' if s == 'Jpan' else fixed.SCRIPT_NAMES[s])}" for s in charsets.SCRIPTS) + " ELSE 'Other' END"
    shares = sample_letters() + f", per AS (SELECT sample, {other} AS script, CAST(sum(n) AS BIGINT) AS n FROM letters GROUP BY ALL) "
    letter = charsets.char_class("letter")
    return {
        "normalize_text": with_(NORM) + "SELECT doc_id, norm FROM norm",
        "tokenize": sample_tokens + "SELECT doc_id, unnest(range(len(w))) AS pos, unnest(w) AS word FROM tok",
        "token_stats": sample_tokens + "SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct, CAST(coalesce(list_max([length(x) for x in w]), 0) AS BIGINT) AS longest FROM tok",
        "script_letter_counts": with_(NORM, letter_counts()) + f"SELECT doc_id, {', '.join(f'{s} AS {s.lower()}' for s in charsets.SCRIPTS)} FROM lc",
        "dominant_script": with_(NORM, TOKENS, letter_counts(), dominant()) + "SELECT doc_id, script, n_script, round_even(script_share, 6) AS script_share, CAST(len(w) AS BIGINT) AS n_words FROM dom JOIN tok USING (doc_id)",
        "ngram_counts": with_(*base, GRAMS) + "SELECT ngram, CAST(sum(cnt) AS BIGINT) AS cnt, count(*) AS n_docs FROM grams GROUP BY ngram",
        "ngram_top300": with_(*base, GRAMS, TOP) + "SELECT doc_id, ngram, cnt, rank FROM top",
        "cue_scores": with_(*base, cues()) + "SELECT doc_id, language_code, cue_sum, unique_sum FROM cue",
        "distinctive_scores": with_(NORM, letters()) + "SELECT doc_id, language_code, round_even(CAST(weight AS DOUBLE), 4) AS weight FROM dist WHERE weight > 0",
        "rank_distance": with_(*base, GRAMS, TOP, letter_counts(), dominant(), distances()) + "SELECT doc_id, language_code, round_even(distance, 9) AS distance FROM far",
        "build_profiles": with_(NORM, TOKENS, "wc AS (SELECT lang, word, count(*) AS cnt, min(CAST(doc_id AS HUGEINT) * 100000000 + pos) AS first FROM (SELECT doc_id, lang, unnest(w) AS word, unnest(range(len(w))) AS pos FROM tok) GROUP BY ALL)",
            f"g AS (SELECT lang, ngram, CAST(sum(cnt) AS BIGINT) AS cnt, min(first * 1000000 + off) AS first FROM (SELECT lang, cnt, first, unnest(gs) AS ngram, unnest(range(len(gs))) AS off FROM (SELECT *, {CUT} AS gs FROM wc)) GROUP BY ALL)")
        + "SELECT lang, ngram, cnt, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY cnt DESC, first) - 1 AS rank FROM g) WHERE rank < 800",
        "detect": result + "SELECT * FROM res",
        "detect_rowlocal": result + "SELECT * FROM res",
        "detect_alternatives": with_(*full) + "SELECT doc_id, language_code, score FROM soft",
        "detect_confusion": result + "SELECT lang, resolution, coalesce(language_code, 'und') AS detected, count(*) AS n FROM res JOIN documents USING (doc_id) GROUP BY ALL",
        "eval_totals": result + rows + f", t AS (SELECT {measures} FROM evr) SELECT *, {pct('exact', 'cases')} AS exact_share, {pct('exact + script_only', 'cases')} AS useful_share, {pct('attempted', 'cases')} AS coverage, {pct('language_correct', 'attempted')} AS accuracy_when_attempted, {pct('script_correct', 'cases')} AS script_accuracy FROM t",
        "eval_grouping_sets": result + rows + " UNION ALL ".join(sets),
        "eval_confusions": result + rows + "SELECT expected_language, coalesce(predicted, 'und') AS predicted, count(*) AS n FROM evr WHERE resolution = 'wrong' GROUP BY ALL",
        "eval_quality_checks": "WITH w AS (SELECT *, " + words_of + f" AS ws, len(regexp_extract_all(text, {quote(letter)})) AS l FROM documents) "
        f"SELECT 'has_letter' AS \"check\", count(*) FILTER (l = 0) AS n FROM w UNION ALL SELECT 'no_replacement_character', count(*) FILTER (contains(text, chr(65533))) FROM w "
        f"UNION ALL SELECT 'latin_share_over_095', count(*) FILTER (NOT coalesce(len(regexp_extract_all(text, {quote(charsets.char_class('Latn'))})) / nullif(l, 0), 0) > 0.95) FROM w "
        f"UNION ALL SELECT 'all_words_lexical', count(*) FILTER (len(list_filter(ws, lambda x: NOT regexp_matches(x, {quote(letter)}))) > 0) FROM w UNION ALL SELECT 'chars_match', count(*) FILTER (length(text) <> n_chars) FROM w",
        "duplicate_texts": "SELECT md5(text) AS text_md5, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1",
        "exclusive_letters": shares.replace("FROM documents)", "FROM resp)").replace("WITH ", "WITH " + respelled(alphabets) + ", ", 1) + ", domi AS (SELECT sample, first(script ORDER BY n DESC, script) AS script FROM per GROUP BY sample), own AS (SELECT l.sample, domi.script, char, n FROM letters l JOIN domi USING (sample)) SELECT sample, script, char, n FROM own JOIN (SELECT script, char FROM own GROUP BY ALL HAVING count(*) = 1) USING (script, char)",
        "script_shares": shares + "SELECT sample, script, n, round_even(n / sum(n) OVER (PARTITION BY sample), 9) AS share FROM per",
        "diagnostic_counts": sample_letters() + f", d(kind, char) AS (VALUES {', '.join(f'({quote(g)}, {quote(c)})' for g, cs in DIAGNOSTIC.items() for c in cs)}) SELECT kind, sample, char, n FROM letters JOIN d USING (char)",
        "top_letters": sample_letters() + ranked("letters", "char", 20),
        "top_words": sample_tokens + ", c AS (SELECT lang AS sample, word, count(*) AS n FROM (SELECT lang, unnest(w) AS word FROM tok) GROUP BY ALL) " + ranked("c", "word", 15),
        "top_bigrams": sample_tokens + ", c AS (SELECT lang AS sample, bigram, count(*) AS n FROM (SELECT lang, unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS bigram FROM tok) GROUP BY ALL) " + ranked("c", "bigram", 8),
        "first_n_words": f"SELECT doc_id, array_to_string({words_of}[1:1000], ' ') AS words FROM documents",
        "lexical_words": f"SELECT doc_id, CAST(len(list_filter({words_of}, lambda x: regexp_matches(x, {quote(letter)}))) AS BIGINT) AS n_lexical, CAST(len({words_of}) AS BIGINT) AS n_words FROM documents",
        "latin_share": f"SELECT doc_id, round_even(coalesce({count_of('Latn', 'text')} / nullif({count_of('letter', 'text')}, 0), 0), 9) AS share FROM documents",
        "text_digests": "SELECT item_id, sha256(text) AS sha256 FROM benchmark",
        "uyghur_transliterate": uyghur(letters_for_uyghur),
        "script_letters_respelled": with_(respelled(alphabets), NORM.replace("FROM documents", "FROM resp"), letter_counts()) + f"SELECT doc_id, {', '.join(f'{s} AS {s.lower()}' for s in charsets.SCRIPTS)} FROM lc",
        "scripts_respelled": with_(respelled(alphabets), NORM.replace("FROM documents", "FROM resp"), letter_counts(), dominant_by_order()) + "SELECT lang AS sample, script, script IS NULL AS nothing, count(*) AS n FROM dom JOIN resp USING (doc_id) GROUP BY ALL",
        "case_buckets": "SELECT key, word_count, CAST(5 AS BIGINT) AS n FROM (SELECT DISTINCT printf('d%06d', doc_id // 250) AS key FROM documents WHERE regexp_matches(text, '\\S')), (SELECT unnest([1, 2, 3, 5, 10, 20, 50, 100]) AS word_count)",
        "detect_mixed_spans": "WITH " + spans(result) + ' SELECT conv_id, turn, s AS start, e AS "end", script, language_code, confidence, resolution FROM span_res',
        "detect_mixed_summary": "WITH " + spans(result) + ", " + summary(),
        "script_boundaries": script_cuts(alphabets),
        "window_cases": windows(),
        "parsed_predictions": predictions(shapes),
        "case_checks": case_checks(),
        "normalize_composed": composed(marked),
        "clause_boundaries": "WITH " + clauses() + " SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_concat([0, length(text)], [CAST(e AS BIGINT) for e in ends]))), ' ') AS cuts FROM acc",
    }
