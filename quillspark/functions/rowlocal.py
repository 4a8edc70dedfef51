"""Detection of batches of texts without a shuffle, for Arrow functions, streams and spans."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..resources import fixed
from . import charsets

TOP = 300
SIZES = (2, 3, 4)
#: What ends a clause.
CLAUSE = re.compile(r"(?:\r\n|\r|\n|[.!?;:]+)[\t \f\v]*")
_FOLD = str.maketrans(dict.fromkeys(fixed.APOSTROPHES, "'"))
_CURLY = frozenset(fixed.APOSTROPHES) - {"'"}
#: Rows of n-grams and bytes of words that are worked off together; a single text may have more. Nothing is remembered
#: from one lot to the next.
ROWS, KNOWN = 1 << 20, 1 << 18


def normalise(text: str) -> str:
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFKC", text).casefold().replace("i̇", "i")


@lru_cache(maxsize=1)
def _word_pattern():
    c = charsets.python_class("word")
    return re.compile(f"{c}+(?:'{c}+)*"), re.compile(r"[a-z]+(?:'[a-z]+)*")


def tokens(norm: str) -> list[str]:
    """Words of a normalised text."""
    folded = norm if norm.isascii() or _CURLY.isdisjoint(norm) else norm.translate(_FOLD)
    general, plain = _word_pattern()
    return (plain if folded.isascii() else general).findall(folded)


@lru_cache(maxsize=1 << 16)
def _script(char: str) -> str | None:
    return charsets.script_of(char)


def grams_of(word: str) -> tuple[str, ...]:
    """n-grams of a padded word: by size, then by place."""
    padded = f"^{word}$"
    return tuple(padded[i : i + n] for n in SIZES for i in range(len(padded) - n + 1))


def scripts_at(text: str) -> list[tuple[int, str]]:
    """(position, script) of every letter of a supported script; with kana, Han is Japanese."""
    known = {c: s for c in set(text) if (s := _script(c)) is not None}
    if "Jpan" in known.values():
        known = {c: "Jpan" if s == "Hani" else s for c, s in known.items()}
    return [(i, known[c]) for i, c in enumerate(text) if c in known]


def script_changes(text: str) -> list[int]:
    """Positions of letters whose script is not that of the letter before."""
    if text.isascii():
        return []
    at = scripts_at(text)
    return [b for (_, s), (b, t) in zip(at, at[1:], strict=False) if s != t]


def census(text: str) -> tuple[str, list[dict]]:
    """The normalised text, and how often and from where on each script's letters are in it."""
    norm = normalise(text)
    found: dict[str, list[int]] = {}
    for c, n in Counter(norm).items():  # in order of first occurrence
        if (s := _script(c)) is not None:
            if s in found:
                found[s][0] += n
            else:
                found[s] = [n, norm.index(c)]
    if "Jpan" in found and "Hani" in found:
        han = found.pop("Hani")
        found["Jpan"] = [found["Jpan"][0] + han[0], min(found["Jpan"][1], han[1])]
    return norm, [{"script": s, "n": n, "first": at} for s, (n, at) in found.items()]


def is_resolved(script: str, share: float, n_script: int, n_words: int, best: str, top: float, margin: float, distinctive: float, cue: float, unique: float) -> bool:
    """Whether the evidence names a language: a table of guards by length, then the exceptions."""
    guards = (
        (share < 0.70, False),
        (n_script <= 2, (distinctive >= 2.5 and top >= 0.80) or (cue >= 0.9 and top >= 0.85)),
        (n_words <= 1, (top >= 0.93 and margin >= 0.60) or (distinctive >= 1.0 and top >= 0.55) or (cue >= 0.9 and top >= 0.70)),
        (n_words <= 3, top >= 0.66 and margin >= 0.20),
        (n_words >= 1000, top >= 0.20 and margin >= 0.10),
        (True, top >= 0.30 and margin >= 0.05),
    )
    ok = next(verdict for guard, verdict in guards if guard)
    if not ok and script == "Latn" and n_words <= 3:
        ok = unique >= 0.50 and top >= 0.30 and margin >= 0.10
    if best == "pcm" or script == "Deva":
        ok = ok and (distinctive > 0 or unique > 0)
    return ok


def empty_result() -> dict:
    return {"script": None, "language_code": None, "confidence": 0.0, "alternatives": [], "resolution": "none", "label": "Unknown script · uncertain"}


def codes(texts: pa.Array) -> np.ndarray:
    """Code points of all strings of an array, one after the other."""
    ends, data = np.frombuffer(texts.buffers()[1], np.int32), texts.buffers()[2]
    used = data.to_pybytes()[ends[texts.offset] : ends[texts.offset + len(texts)]] if data else b""
    return np.frombuffer(used.decode().encode("utf-32-le"), np.uint32).astype(np.int64)


def _numbers(first: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of values in order of occurrence, those of ``first`` ahead, and the values by number."""
    found = pa.array(np.concatenate([first, values])).dictionary_encode()
    return found.indices.to_numpy()[len(first) :].astype(np.int64), found.dictionary.to_numpy()


_PAIR = 21  # bits of a code point


class _Fixed:
    """The n-grams that profiles hold, by the numbers of their letters and pairs, in the order that their own numbers have."""

    def __init__(self, grams: list[str]):
        code = np.zeros((len(grams), max(SIZES)), np.int64)
        for n in SIZES:
            mine = [i for i, g in enumerate(grams) if len(g) == n]
            code[mine, :n] = codes(pa.array([grams[i] for i in mine], pa.string())).reshape(-1, n)
        size = np.array([len(g) for g in grams], np.int64)
        none = np.empty(0, np.int64)
        letter, self.letters = _numbers(none, code.ravel())
        head, tail = (code[:, 0] << _PAIR) | code[:, 1], (code[:, 2] << _PAIR) | code[:, 3]
        pair, self.pairs = _numbers(none, np.append(head, tail))
        head, tail = pair[: len(grams)], pair[len(grams) :]
        rest = np.where(size == 4, tail, np.where(size == 3, letter.reshape(code.shape)[:, 2], 0))
        kept = np.flatnonzero(np.isin(size, SIZES))
        self.row = kept[np.lexsort((rest[kept], head[kept], size[kept]))]
        self.size, self.head, self.rest = size[self.row], head[self.row], rest[self.row]


class _Cut:
    """The n-grams of many words, cut at once.

    Letters and pairs of letters are numbered, those of profiles first. Of P pairs and L letters, an n-gram of two is its pair, one
    of three a number of P * L behind those, and one of four, as two pairs, a number of P * P behind these. So
    n-grams need no table of their own, and what is held is bounded by the words at hand.
    """

    def __init__(self, words: pa.Array, fixed: _Fixed):
        padded = pc.binary_join_element_wise("^", words, "$", "")
        code = np.append(codes(padded), [0, 0, 0])
        size = pc.utf8_length(padded).to_numpy(zero_copy_only=False).astype(np.int64)
        letter, self.letters = _numbers(fixed.letters, code)
        pair, self.pairs = _numbers(fixed.pairs, (code[:-1] << _PAIR) | code[1:])
        self.fixed, m = fixed, len(code) - 3
        self.three = len(self.pairs)
        self.four = self.three + len(self.pairs) * len(self.letters)
        self.grams = np.concatenate([pair[:m], self.three + pair[:m] * len(self.letters) + letter[2 : m + 2], self.four + pair[:m] * len(self.pairs) + pair[2 : m + 2]])
        # stretches of ``grams`` that are of a word, one for each size
        self.start = (np.cumsum(size) - size)[:, None] + np.arange(len(SIZES)) * m
        self.count = np.maximum(size[:, None] - np.array(SIZES) + 1, 0)

    def of(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n-grams of words given by number, by size and then by place, and how many each word has."""
        count = self.count[word].ravel()
        skipped = self.start[word].ravel() - (np.cumsum(count) - count)
        return self.grams[np.arange(count.sum()) + np.repeat(skipped, count)], self.count.sum(axis=1)[word]

    def rows(self, gram: np.ndarray) -> np.ndarray:
        """Rows of n-grams in the tables of ranks; the last one is for those that no profile holds."""
        f = self.fixed
        number = np.where(f.size == 2, f.head, np.where(f.size == 3, self.three + f.head * len(self.letters) + f.rest, self.four + f.head * len(self.pairs) + f.rest))
        if not len(number):
            return np.zeros(len(gram), np.int64)
        at = np.minimum(np.searchsorted(number, gram), len(number) - 1)
        return np.where(number[at] == gram, f.row[at], -1)

    def names(self, gram: np.ndarray) -> pa.Array:
        """n-grams as strings."""
        p, n = len(self.pairs), len(self.letters)
        two, three = gram < self.three, gram < self.four
        code = np.zeros((len(gram), max(SIZES)), np.uint32)
        head = self.pairs[np.where(two, gram, np.where(three, (gram - self.three) // n, (gram - self.four) // p))]
        tail = self.pairs[np.where(three, 0, (gram - self.four) % p)]
        code[:, 0], code[:, 1] = head >> _PAIR, head & ((1 << _PAIR) - 1)
        code[:, 2] = np.where(two, 0, np.where(three, self.letters[np.where(three & ~two, (gram - self.three) % n, 0)], tail >> _PAIR))
        code[:, 3] = np.where(three, 0, tail & ((1 << _PAIR) - 1))
        return pa.array(code.view("<U4").ravel(), pa.string())


def order(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in order of the keys, the first one first, and of equals by place, and where runs of equal keys begin: one sort of packed numbers if they fit."""
    n = len(keys[0])
    bits = [int(k.max()).bit_length() for k in keys] + [n.bit_length()]
    if sum(bits) > 63:
        places = np.lexsort(keys[::-1])
        return places, np.flatnonzero(_changes(*(k[places] for k in keys)))
    packed = keys[0].astype(np.int64)
    for key, b in zip((*keys[1:], np.arange(n)), bits[1:], strict=True):
        packed <<= b
        packed |= key
    packed.sort()
    places = packed & ((1 << bits[-1]) - 1)
    packed >>= bits[-1]
    return places, np.flatnonzero(_changes(packed))


def _changes(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = keys[0][1:] != keys[0][:-1]
    for key in keys[1:]:
        new = new | (key[1:] != key[:-1])
    return np.append(True, new)


def _top(gram: np.ndarray, text: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, ...]:
    """``gram, count, text, rank`` of the TOP n-grams of each text by count, then by first occurrence; texts are in order."""
    if not len(gram):
        return gram, times, text, text
    # equal n-grams of a text stand together, the first occurrence ahead
    by_gram, new = order(text, gram)
    count, first = np.add.reduceat(times[by_gram], new), by_gram[new]
    text = text[first]
    # a first occurrence is of one n-gram of one text, so the order of places is one of texts too
    by_rank, _ = order(text, count.max() - count, first)
    count, first, text = count[by_rank], first[by_rank], text[by_rank]
    begin = np.flatnonzero(_changes(text))
    rank = np.arange(len(text)) - np.repeat(begin, np.diff(np.append(begin, len(text))))
    kept = rank < TOP
    return gram[first[kept]], count[kept], text[kept], rank[kept]


class Detector:
    """Profiles as one table of ranks by script, built once; picklable, so that a worker gets it ready.

    A batch of texts goes through together. All words are cut into numbered n-grams at once; the n-grams of
    all texts are counted by one sort of (text, n-gram) and ranked by another; one lookup gives their ranks
    in all profiles of a script, and sums over each text's stretch give the distances.
    """

    def __init__(self, profiles: list[dict]):
        self.languages: dict[str, list[str]] = {}
        by_script: dict[str, list[dict]] = {}
        for p in profiles:
            by_script.setdefault(p["script"], []).append(p)
            known = self.languages.setdefault(p["script"], [])
            if p["language_code"] not in known:
                known.append(p["language_code"])
        # the n-grams that profiles hold are rows of the rank tables
        self.fixed_ids = {g: i for i, g in enumerate(dict.fromkeys(g for p in profiles for g in p["ngrams"]))}
        self.ranks: dict[str, np.ndarray] = {}
        self.sizes: dict[str, np.ndarray] = {}
        self.owners: dict[str, list[str]] = {}
        for script, mine in by_script.items():
            if len(self.languages[script]) == 1:
                continue
            size = np.array([len(p["ngrams"]) for p in mine])
            table = np.tile(size.astype(np.int32), (len(self.fixed_ids) + 1, 1))  # the last row is for all other n-grams
            for j, p in enumerate(mine):
                table[[self.fixed_ids[g] for g in p["ngrams"]], j] = np.arange(len(p["ngrams"]))
            self.ranks[script], self.sizes[script], self.owners[script] = table, size, [p["language_code"] for p in mine]
        self.cues = {k: set(v) for k, v in fixed.CUES.items()}
        self.unique = fixed.unique_cues()
        self.cue_words = frozenset().union(*self.cues.values())
        self.letters = frozenset(c for weights in fixed.DISTINCTIVE.values() for c in weights)
        self.fixed = _Fixed(list(self.fixed_ids))
        self.cut: _Cut | None = None

    def __getstate__(self):
        return self.__dict__ | {"cut": None}

    def distances(self, script: str, texts: list[Counter]) -> np.ndarray:
        """The least rank distance of each language's profiles: a row for each text, given by its words in order."""
        out = np.ones((len(texts), len(self.languages[script])))
        a = 0
        while a < len(texts):
            b, rows = a, 0
            while b < len(texts) and (b == a or rows < ROWS):
                rows += sum(map(len, texts[b])) * 3
                b += 1
            out[a:b] = self._distances(script, texts[a:b])
            a = b
        return out

    def _distances(self, script: str, texts: list[Counter]) -> np.ndarray:
        words, times = [w for t in texts for w in t], [n for t in texts for n in t.values()]
        self.cut = _Cut(pa.array(words, pa.string()), self.fixed)
        gram, size = self.cut.of(np.arange(len(words)))
        text = np.repeat(np.repeat(np.arange(len(texts)), list(map(len, texts))), size)
        top = _top(gram, text, np.repeat(np.array(times, np.int64), size))
        return self.far(script, len(texts), *top)

    def top(self, text: np.ndarray, word: np.ndarray, words: pa.Array) -> tuple[np.ndarray, ...]:
        """``gram, count, text, rank`` of the TOP n-grams of each text, by text and rank.

        Texts are given by their words in order: the text and the number of each, and all words by number. N-grams
        are numbers, which ``cut`` names until the next call.
        """
        return _top(*self._grams(text, word, words))

    def totals(self, text: np.ndarray, word: np.ndarray, words: pa.Array) -> tuple[np.ndarray, ...]:
        """``gram, count, texts``: how often and in how many of the texts each n-gram occurs; texts as for ``top``."""
        gram, text, times = self._grams(text, word, words)
        if not len(gram):
            return gram, times, text
        by_gram, once = order(gram, text)
        gram, times = gram[by_gram[once]], np.add.reduceat(times[by_gram], once)
        new = np.flatnonzero(_changes(gram))
        return gram[new], np.add.reduceat(times, new), np.diff(np.append(new, len(gram)))

    def _grams(self, text: np.ndarray, word: np.ndarray, words: pa.Array) -> tuple[np.ndarray, ...]:
        """``gram, text, times`` of the n-grams of each text's different words, in order of their first occurrence."""
        self.cut = _Cut(words, self.fixed)
        if not len(word):
            return (np.empty(0, np.int64),) * 3
        # the different words of each text, in order of their first occurrence
        by_word, new = order(text, word)
        times, first = np.diff(np.append(new, len(by_word))), by_word[new]
        by_place = np.argsort(first)
        times, first = times[by_place], first[by_place]
        text, word = text[first], word[first]
        gram, size = self.cut.of(word)
        return gram, np.repeat(text, size), np.repeat(times, size)

    def far(self, script: str, n: int, gram: np.ndarray, count: np.ndarray, text: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The least rank distance of each language's profiles to the ``top`` of ``n`` texts."""
        languages = self.languages[script]
        out = np.ones((n, len(languages)))
        if not len(gram):
            return out
        table, sizes = self.ranks[script], self.sizes[script]
        away = np.abs(rank.astype(np.int32)[:, None] - table[self.cut.rows(gram)])
        some = np.flatnonzero(_changes(text))
        far = np.add.reduceat(away, some, axis=0, dtype=np.int64) / (np.diff(np.append(some, len(text)))[:, None] * sizes)
        rows = text[some]
        for j, language in enumerate(self.owners[script]):
            k = languages.index(language)
            out[rows, k] = np.minimum(out[rows, k], far[:, j])
        return out

    def detect(self, text: str | None) -> dict | None:
        return self.detect_all([text])[0]

    def detect_all(self, texts: list[str | None]) -> list[dict | None]:
        """A detection for each text, null for null."""
        out: list[dict | None] = [None] * len(texts)
        by_script: dict[str, list[tuple]] = {}
        for i, text in enumerate(texts):
            if text is None:
                continue
            norm, letters = census(text)
            if not letters:
                out[i] = empty_result()
                continue
            counts = {x["script"]: x["n"] for x in letters}
            script = max(letters, key=lambda x: (x["n"], x["script"] != "Latn", -x["first"]))["script"]
            chars = {c: norm.count(c) for c in self.letters.intersection(norm)}
            by_script.setdefault(script, []).append((i, counts[script], counts[script] / sum(counts.values()), chars, Counter(tokens(norm))))
        for script, found in by_script.items():
            several = len(self.languages[script]) > 1
            away = self.distances(script, [f[-1] for f in found]).tolist() if several else [[0.0]] * len(found)
            for (i, *features), far in zip(found, away, strict=True):
                out[i] = self._decide(script, *features, far)
        return out

    def _decide(self, script: str, n_script: int, share: float, chars: dict[str, int], words: Counter, far: list[float]) -> dict:
        n_words = sum(words.values())
        by_letters, by_words = math.sqrt(max(1, n_script)), math.sqrt(max(1, n_words))
        cue_words = self.cue_words & words.keys()
        distinctive, cue, unique, raw = {}, {}, {}, {}
        for k, distance in zip(self.languages[script], far, strict=True):
            weights = fixed.DISTINCTIVE.get(k) if chars else None
            distinctive[k] = sum(chars[c] * w for c, w in weights.items() if c in chars) / by_letters if weights else 0.0
            mine = self.cues.get(k, set()) & cue_words if cue_words else ()
            cue[k] = sum(min(words[w], 3) for w in mine) / by_words if mine else 0.0
            unique[k] = sum(min(words[w], 3) for w in mine & self.unique.get(k, set())) / by_words if mine else 0.0
            raw[k] = -7 * distance + 1.25 * distinctive[k] + 0.9 * cue[k] + (5 * unique[k] if n_words == 1 else 0)
        most = max(raw.values())
        exps = {k: math.exp(v - most) for k, v in raw.items()}
        total = sum(exps.values())
        ranked = [(k, round(exps[k] / total, 6)) for k in sorted(exps, key=lambda k: -exps[k])]
        best, top = ranked[0]
        margin = top - (ranked[1][1] if len(ranked) > 1 else 0.0)
        ok = is_resolved(script, share, n_script, n_words, best, top, margin, distinctive[best], cue[best], unique[best])
        language = best if ok else None
        return {
            "script": script,
            "language_code": language,
            "confidence": round(top * share if ok else share, 6),
            "alternatives": [{"language_code": k, "score": s} for k, s in ranked],
            "resolution": "language" if ok else "script",
            "label": f"{fixed.SCRIPT_NAMES[script]} · {fixed.LANGUAGE_NAMES[language] if language else 'uncertain'}",
        }

    def spans(self, text: str) -> list[dict]:
        return self.spans_all([text])[0]

    def spans_all(self, texts: list[str]) -> list[list[dict]]:
        """Ordered spans that make up each text, each detected on its own text.

        Pieces of all texts are detected together, equal ones once; a span of one piece is not detected again.
        """
        cuts = [sorted({0, len(t), *(m.end() for m in CLAUSE.finditer(t)), *script_changes(t)}) for t in texts]
        bounds = [list(zip(c, c[1:], strict=False)) for c in cuts]
        known = self._distinct(t[a:b] for t, ab in zip(texts, bounds, strict=True) for a, b in ab)
        grouped = [self._grouped(t, ab, known) for t, ab in zip(texts, bounds, strict=True)]
        known |= self._distinct(t[a:b] for t, groups in zip(texts, grouped, strict=True) for a, b in groups if t[a:b] not in known)
        return [[{"start": a, "end": b, "text": t[a:b], **known[t[a:b]]} for a, b in groups] for t, groups in zip(texts, grouped, strict=True)]

    def _distinct(self, texts) -> dict[str, dict]:
        different = list(dict.fromkeys(texts))
        return dict(zip(different, self.detect_all(different), strict=True))

    @staticmethod
    def _grouped(text: str, bounds: list[tuple[int, int]], known: dict[str, dict]) -> list[tuple[int, int]]:
        """Neighbouring pieces of one script and language as one span; pieces without a script go with the span
        before them, leading ones with the first."""
        marks = [None if (d := known[text[a:b]])["script"] is None else (d["script"], d["language_code"]) for a, b in bounds]
        first = next((m for m in marks if m is not None), None)
        begins, now = [], None
        for (a, _), mark in zip(bounds, marks, strict=True):
            filled = mark or (first if not begins else now)
            if not begins or filled != now:
                begins.append(a)
            now = filled
        return list(zip(begins, [*begins[1:], len(text)], strict=True)) if begins else []

    def mixed(self, text: str | None) -> dict | None:
        return self.mixed_all([text])[0]

    def mixed_all(self, texts: list[str | None]) -> list[dict | None]:
        there = [t for t in texts if t is not None]
        spans = self.spans_all(there)
        whole = {s[0]["text"]: s[0] for s in spans if len(s) == 1}
        rest = self._distinct(t for t in there if t not in whole)
        primary = lambda t: rest[t] if t in rest else {k: v for k, v in whole[t].items() if k not in ("start", "end", "text")}
        found = iter([_summary(primary(t), s) for t, s in zip(there, spans, strict=True)])
        return [None if t is None else next(found) for t in texts]


def _summary(primary: dict, spans: list[dict]) -> dict:
    scripts = list(dict.fromkeys(s["script"] for s in spans if s["script"]))
    languages = list(dict.fromkeys(s["language_code"] for s in spans if s["language_code"]))
    return {
        "primary": primary,
        "segments": spans,
        "scripts": scripts,
        "language_codes": languages,
        "is_mixed_script": len(scripts) > 1,
        "is_mixed_language": len(languages) > 1,
        "is_mixed": len(scripts) > 1 or len(languages) > 1,
        "has_unresolved_segments": any(s["language_code"] is None for s in spans),
    }
