"""Token counts by a linear longest-match automaton.

Greedy longest-match-first splitting of every word, in one pass: a trie of the vocabulary
whose failure links carry how many pieces are complete when a link is taken. Pieces are counted and never built.
"""

from __future__ import annotations

import json
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
END = "</w>"
#: The symbol of a word's end.
FREE = (256,)
#: Words of lower-cased text: letters, single digits, runs of other visible characters.
SPLIT = re.compile(r"[^\W\d_]+|\d|(?:[^\s\w]|_)+")
MEMO, MEMO_WORD, LIST_CHARS = 1 << 18, 64, 1 << 22


def byte_symbols() -> dict[int, str]:
    """The visible character that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def load_pieces(path: str) -> list[tuple[int, ...]]:
    """Pieces of a tokenizer file as symbols: bytes, and 256 for the end of a word."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    back = {c: b for b, c in byte_symbols().items()}
    out = []
    for piece in vocabulary:
        body, end = (piece[: -len(END)], (256,)) if piece.endswith(END) else (piece, ())
        if all(c in back for c in body):
            out.append((*(back[c] for c in body), *end))
    return [p for p in out if p]


class Automaton:
    """``child[node << 9 | symbol]``, and by node: failure link (-1: none) and popped pieces.

    The end of a word may be left over by itself and is no piece then.
    """

    def __init__(self, pieces):
        child, is_piece, parent = {}, [False], [(0, 0)]
        for piece in (*pieces, FREE):
            node = 0
            for s in piece:
                key = node << 9 | s
                if key not in child:
                    child[key] = len(is_piece)
                    is_piece.append(False)
                    parent.append((node, s))
                node = child[key]
            is_piece[node] = True
        link, popped = [-1] * len(is_piece), [0] * len(is_piece)
        below: dict[int, list] = {}
        for node, (up, _) in enumerate(parent[1:], 1):
            below.setdefault(up, []).append(node)
        queue = deque(below.get(0, []))
        while queue:  # by depth, so that shorter strings are settled
            node = queue.popleft()
            queue.extend(below.get(node, []))
            up, s = parent[node]
            if is_piece[node]:
                link[node], popped[node] = 0, int(parent[node] != (0, FREE[0]))
                continue
            at, n = link[up], popped[up]
            while at >= 0 and at << 9 | s not in child:
                n += popped[at]
                at = link[at]
            if at >= 0:
                link[node], popped[node] = child[at << 9 | s], n
        self.child, self.link, self.popped = child, link, popped

    def count(self, symbols) -> int | None:
        """Pieces of the greedy split of a word, None if it has none."""
        child, link, popped = self.child, self.link, self.popped
        node = n = 0
        for s in symbols:
            while (down := child.get(node << 9 | s)) is None:
                n += popped[node]
                node = link[node]
                if node < 0:
                    return None
            node = down
        while node:
            n += popped[node]
            node = link[node]
            if node < 0:
                return None
        return n


class Memo(dict):
    """Counts of short words seen, at most MEMO of them; an unknown word is one token."""

    def __init__(self, automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word):
        n = self.automaton.count([*word.encode("utf-8", "surrogatepass"), 256])
        n = 1 if n is None else n
        if len(word) <= MEMO_WORD:
            if len(self) >= MEMO:
                self.clear()
            self[word] = n
        return n


_built: dict[int, Automaton] = {}


def _automaton(pieces) -> Automaton:
    """Built once for each Python worker, which keeps the last one."""
    key = hash(tuple(pieces))
    if key not in _built:
        _built.clear()
        _built[key] = Automaton(pieces)
    return _built[key]


def _count(shared):
    def run(batches):
        memo = Memo(_automaton(shared.value))
        get = memo.__getitem__
        for batch in batches:
            words, tokens = [], []
            for text in batch.column("text"):
                text = (text.as_py() or "").lower()
                n = total = 0
                if len(text) <= LIST_CHARS:
                    found = SPLIT.findall(text)
                    n, total = len(found), sum(map(get, found))
                else:  # without a list of all words
                    for m in SPLIT.finditer(text):
                        n += 1
                        total += get(m[0])
                words.append(n)
                tokens.append(total)
            rest = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], [*rest, "n_words", "n_tokens"])

    return run


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_words, n_tokens`` of every whole text: greedy word pieces of its words.

    Null and empty texts have none of either. A word that the vocabulary cannot spell is one
    token. Rows are independent: repeated rows repeat their counts, an empty table gives none.
    The vocabulary is read by the driver and broadcast; it does not grow with the data.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_pieces(vocabulary))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(_count(shared), f"doc_id {kind}, n_words long, n_tokens long")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
