"""Secret scans: base patterns, and formats learnt as probabilistic automata."""

from __future__ import annotations

import hashlib
import math
import re
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table

KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
SHORTEST = 12
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_.=-]{{{SHORTEST},}}")
NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey")
#: Strings of each kind, and other candidates, that the formats are learnt and calibrated on, and the
#: documents that they are taken from: those of least hash, whole.
SAMPLE, SAMPLE_DOCS = 600, 4000
#: Characters of a string that may be learnt from at most, and of all strings of a kind: an automaton starts from a state for
#: each character of its strings. Longer strings are scanned like others, and are typical of no kind.
LONGEST, SAMPLE_CHARS = 512, 40_000
#: A kind with fewer labelled strings than this gives no format (``Formats.skipped`` names it).
LEAST = 5
ALPHA = 0.05
#: Every third string is withheld from learning. Of the withheld credentials of a kind this share
#: may be less typical of it than the rule asks for; of the withheld other strings so many may pass.
MISSED, FALSE = 0.02, 0.001
#: A credential is at least this much likelier than an ordinary string, in bits.
MARGIN = 8.0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches, sorted; kinds are independent of each other."""
    out = []
    low = text.lower()
    if any(n in low for n in NAMES):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


_CLASS = {**{c: "0" for c in "0123456789"}, **{c: "f" for c in "abcdef"}, **{chr(c): "z" for c in range(0x67, 0x7B)}, **{c: "F" for c in "ABCDEF"}, **{chr(c): "Z" for c in range(0x47, 0x5B)}}
_TABLE = str.maketrans(_CLASS)


def symbols(word: str) -> str:
    """Classes of characters; punctuation stands for itself."""
    return word.translate(_TABLE)


class Automaton:
    """A probabilistic automaton: counts of passages, of ends and of each move."""

    def __init__(self, words: list[str], alpha: float = ALPHA):
        self.passed, self.ended, self.moves = [0], [0], [{}]
        for word in words:
            node = 0
            self.passed[0] += 1
            for s in word:
                if s not in self.moves[node]:
                    self.moves[node][s] = len(self.passed)
                    self.passed.append(0)
                    self.ended.append(0)
                    self.moves.append({})
                node = self.moves[node][s]
                self.passed[node] += 1
            self.ended[node] += 1
        self.alpha = alpha
        self._merge_states()
        self._score_table()

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        """The Hoeffding bound says that two frequencies are not of one probability."""
        return n1 > 0 and n2 > 0 and abs(f1 / n1 - f2 / n2) > math.sqrt(0.5 * math.log(2 / self.alpha)) * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            na, nb = self.passed[a], self.passed[b]
            if self._differ(self.ended[a], na, self.ended[b], nb):
                return False
            for s in {*self.moves[a], *self.moves[b]}:
                x, y = self.moves[a].get(s), self.moves[b].get(s)
                if self._differ(self.flow[a].get(s, 0), na, self.flow[b].get(s, 0), nb):
                    return False
                if x is not None and y is not None and x != y and min(self.passed[x], self.passed[y]) > 2:
                    todo.append((x, y))
        return True

    def _fold(self, into: int, node: int) -> None:
        """Add the tree below ``node`` to ``into``, move by move."""
        todo = [(into, node)]
        while todo:
            a, b = todo.pop()
            self.passed[a] += self.passed[b]
            self.ended[a] += self.ended[b]
            for s, y in self.moves[b].items():
                self.flow[a][s] = self.flow[a].get(s, 0) + self.flow[b][s]
                if s in self.moves[a]:
                    todo.append((self.moves[a][s], y))
                else:
                    self.moves[a][s] = y

    def _merge_states(self) -> None:
        """Merge compatible states of the prefix tree, nearest the start first."""
        self.flow = [{s: self.passed[y] for s, y in m.items()} for m in self.moves]
        kept, queue = [0], [(0, s) for s in sorted(self.moves[0])]
        while queue:
            up, s = queue.pop(0)
            node = self.moves[up][s]
            if node in kept:
                continue
            for state in kept:
                if self._compatible(state, node):
                    self.moves[up][s] = state
                    self._fold(state, node)
                    break
            else:
                kept.append(node)
            known = set(kept)
            queue = [(k, x) for k in kept for x in sorted(self.moves[k]) if self.moves[k][x] not in known]

    def _score_table(self) -> None:
        """log2 probabilities, smoothed over 70 symbols and the end; an unseen move goes to the start."""
        self.bits, self.end_bits, self.lost = {}, [], []
        for node, n in enumerate(self.passed):
            whole = self.ended[node] + sum(self.flow[node].values()) + 0.5 * 71
            self.end_bits.append(math.log2((self.ended[node] + 0.5) / whole))
            self.lost.append(math.log2(0.5 / whole))
            for s, to in self.moves[node].items():
                self.bits[node, s] = (math.log2((self.flow[node][s] + 0.5) / whole), to)

    def score(self, word: str) -> float:
        node, total = 0, 0.0
        for s in word:
            step = self.bits.get((node, s))
            if step is None:
                total += self.lost[node]
                node = 0
            else:
                total += step[0]
                node = step[1]
        return total + self.end_bits[node]


class Formats:
    """Automata of credentials by kind and of other candidates, and the rule between them.

    A string is a secret if it is typical of a kind (its length is between those of the learnt ones, and its bits
    per symbol under the kind's automaton reach what all but MISSED of the withheld credentials of the
    kind reach) and if that automaton explains it better than the one of other strings by
    ``limit`` bits: MARGIN, or more if more than FALSE of the withheld other strings would
    pass. Punctuation is a symbol like any other, so a form that no credential has is not typical.
    """

    def __init__(self, by_kind: dict[str, list[str]], other: list[str], least: int = LEAST):
        self.skipped = {k: len(words) for k, words in by_kind.items() if len(words) < least}
        learn, held = {}, {}
        for kind, words in [*sorted(by_kind.items()), ("other", other)]:
            words = sorted(set(words), key=lambda w: hashlib.sha256(w.encode()).digest())
            learn[kind] = [symbols(w) for i, w in enumerate(words) if i % 3 or len(words) < 3]
            held[kind] = [symbols(w) for w in words[::3]]
        self.other = Automaton(sorted(learn["other"]))
        self.kinds = {k: Automaton(sorted(learn[k])) for k in sorted(by_kind) if k not in self.skipped}
        self.typical = {k: _quantile([a.score(w) / (len(w) + 1) for w in held[k]], MISSED) for k, a in self.kinds.items()}
        self.lengths = {k: (min(map(len, learn[k])), max(map(len, learn[k]))) for k in self.kinds}
        self.limit = MARGIN
        self.memo: dict[str, float] = {}
        ratios = sorted(self.bits(w) for w in held["other"])
        if ratios:
            self.limit = max(MARGIN, _quantile(ratios, 1 - FALSE) + 1e-9)
        self.memo.clear()

    def bits(self, word: str) -> float:
        """By how many bits the best format that the string is typical of explains it better than other strings are explained; -inf if it is typical of none."""
        s = symbols(word)
        known = self.memo.get(s)
        if known is None:
            scores = ((k, a.score(s)) for k, a in self.kinds.items() if self.lengths[k][0] <= len(s) <= self.lengths[k][1])
            fitting = [x for k, x in scores if x / (len(s) + 1) >= self.typical[k]]
            known = max(fitting) - self.other.score(s) if fitting else -math.inf
            if len(self.memo) >= 1 << 17:
                self.memo.clear()
            if len(s) <= 200:
                self.memo[s] = known
        return known

    def is_secret(self, word: str) -> bool:
        return self.bits(word) >= self.limit


def _quantile(values: list[float], q: float) -> float:
    """The value that a share ``q`` of all lies below."""
    ordered = sorted(values)
    return ordered[min(int(q * len(ordered)), len(ordered) - 1)]


def candidates(text: str, spans: list) -> list[tuple[int, int]]:
    """Runs of credential characters outside of base spans.

    A run that a base span cuts gives the parts around the span, each if it is long enough.
    """
    out, k = [], 0
    ordered = sorted((a, b) for a, _, b in spans)
    for m in CANDIDATE.finditer(text):
        a, end = m.span()
        while k < len(ordered) and ordered[k][1] <= a:
            k += 1
        j = k
        while a < end:
            x, y = ordered[j] if j < len(ordered) else (end, end)
            if min(x, end) - a >= SHORTEST:
                out.append((a, min(x, end)))
            a, j = max(a, y), j + 1
    return out


def _examples(batches):
    for batch in batches:
        out = {"kind": [], "word": []}
        for text in batch.column("text"):
            text = text.as_py() or ""
            spans = base_spans(text)
            for a, kind, b in spans:
                out["kind"].append(KINDS[kind])
                out["word"].append(ASSIGN.match(text, a)[2] if kind == 0 else text[a:b])
            for a, b in candidates(text, spans):
                out["kind"].append("other")
                out["word"].append(text[a:b])
        yield pa.RecordBatch.from_pydict(out)


def examples(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE, sample_docs: int = SAMPLE_DOCS) -> dict[str, list[str]]:
    """``kind -> strings`` of a bounded sample: base matches are the labelled credentials.

    The ``sample_docs`` texts of least hash that hold a base match, and a quarter as many of any kind, are
    read whole; of all the strings they give, the ``sample`` of least hash per kind are taken, whole too, among those of LONGEST
    characters at most and as far as SAMPLE_CHARS go: that bounds what the driver holds.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    likely = text.rlike(r"""(?i)(password|passwd|secret|token|api_?key)["']? *[:=]|(?-i)AKIA[A-Z0-9]{14}|(?-i)[0-9a-f]{16}""")
    hashed = docs.select(F.xxhash64(text).alias("h"), text.alias("text"), likely.alias("likely"))
    keys = staged(hashed.select("h", "likely").distinct(), "hashes")
    chosen = keys.where("likely").orderBy("h").limit(sample_docs).unionByName(keys.orderBy("h").limit(sample_docs // 4)).select("h").distinct()
    found = hashed.join(F.broadcast(chosen), "h", "left_semi").select("text").distinct().mapInArrow(_examples, "kind string, word string").distinct()
    found = staged(found, "examples")
    short = found.where(F.length("word") <= LONGEST)
    taken = {kind: [r["word"] for r in short.where(F.col("kind") == kind).orderBy(F.xxhash64("word"), "word").limit(sample).collect()] for kind in ("assign", "access", "hex", "other")}
    return {kind: [w for w, total in zip(words, accumulate(map(len, words)), strict=True) if total <= SAMPLE_CHARS] for kind, words in taken.items()}


def train(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE, sample_docs: int = SAMPLE_DOCS) -> Formats:
    """Formats learnt from ``examples``."""
    by = examples(docs, text_col, sample, sample_docs)
    other = by.pop("other")
    return Formats(by, other)


def assess(formats: Formats, credentials: list[str], other: list[str]) -> dict[str, float]:
    """Recall over strings known to be credentials, and precision against others, by format alone."""
    hit, wrong = sum(map(formats.is_secret, credentials)), sum(map(formats.is_secret, other))
    return {"recall": hit / max(1, len(credentials)), "precision": hit / max(1, hit + wrong), "false_rate": wrong / max(1, len(other))}


def _scan(shared):
    def run(batches):
        formats = shared.value
        for batch in batches:
            out = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_format", "format_bits")}
            for text in batch.column("text"):
                text = text.as_py() or ""
                base = base_spans(text)
                scored = [((a, 3, b), formats.bits(text[a:b])) for a, b in candidates(text, base)]
                more = [(span, bits) for span, bits in scored if bits >= formats.limit]
                listed = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
                row = (*(sum(s[1] == k for s in base) for k in range(3)), hashlib.sha256(listed(base).encode()).hexdigest(), listed(sorted(base + [s for s, _ in more])), len(more), [bits for _, bits in more])
                for k, v in zip(out, row, strict=True):
                    out[k].append(v)
            rest = [c for c in batch.schema.names if c != "text"]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *(pa.array(v, t) for v, t in zip(out.values(), types, strict=True))], [*rest, *out])

    return run


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", formats: Formats | None = None) -> DataFrame:
    """Secrets in every whole text: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_format, format_bits``.

    Spans are kind:start:end in code points, end exclusive, by start and then kind, joined by commas;
    the whole match of a base pattern counts. ``format`` spans are the further strings of SHORTEST
    and more credential characters that ``Formats`` takes for secrets, and ``format_bits`` their
    likelihood ratios, in order. Null is empty: no span, the digest of an empty
    string. Repeated rows repeat their results, an empty table gives none. Without ``formats``
    they are learnt from ``docs``.
    """
    formats = formats or train(docs, text_col)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(_scan(docs.sparkSession.sparkContext.broadcast(formats)), f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_format long, format_bits array<double>")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))
