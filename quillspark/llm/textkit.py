"""Vectorised work on texts in Arrow batches: words, shingles, rolling hashes, minimizers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one set of arrays is made for, unless one text is longer.
CHUNK = 1 << 19
U = np.uint64
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BASE = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def seeds(n: int, salt: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U) * _BASE + U(salt))


def chunks(column: pa.Array, limit: int = CHUNK):
    """(first row, bytes, offsets) of runs of rows; a null text is an empty one."""
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, body = column.buffers()
    n = len(column)
    if not n:
        return
    offs = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, side="right")) - 1)
        yield a, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _BASE, U)
    out[0] = 1
    return np.cumprod(out, dtype=U)


def words(data: np.ndarray, offs: np.ndarray):
    """(64-bit hash of each word, A-Z lower-cased; first word of each text and the end)."""
    tok = _WORD[data]
    before = np.empty_like(tok)
    before[:1] = False
    before[1:] = tok[:-1]
    at = offs[:-1]
    before[at[at < len(data)]] = False
    where = np.flatnonzero(tok)
    if not len(where):
        return np.zeros(0, U), np.zeros(len(offs), np.int64)
    first = np.flatnonzero(~before[where])
    size = np.diff(np.append(first, len(where)))
    inside = np.arange(len(where)) - np.repeat(first, size)
    value = (_LOWER[data[where]].astype(U) + U(1)) * powers(int(size.max()))[inside]
    h = mix(np.add.reduceat(value, first) ^ (size.astype(U) << U(48)))
    return h, np.searchsorted(where[first], offs).astype(np.int64)


_ROLE = seeds(64, 11) | U(1)


def shingles(data: np.ndarray, offs: np.ndarray, n: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingles of ``n`` words of each text; of fewer words, but some, one."""
    w, at = words(data, offs)
    g = np.zeros(max(0, len(w) - n + 1), U)
    for j in range(n):
        g += w[j : j + len(g)] * _ROLE[j]
    g = mix(g)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(g[a : b - n + 1]))
        elif b > a:
            out.append(mix((w[a:b] * _ROLE[n : n + b - a]).sum(dtype=U, keepdims=True) + U(b - a)))
        else:
            out.append(np.zeros(0, U))
    return out


def grams(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of the ``k`` bytes from each position on, by doubling; the last k - 1 have none."""
    if len(data) < k:
        return np.zeros(0, U)
    have, h, p = 1, data.astype(U) + U(1), np.array([_BASE])
    out, got, bits = None, 0, k
    while True:
        if bits & 1:
            if out is None:
                out, got = h, have
            else:
                n = min(len(out), len(h) - got)
                out = out[:n] * p + h[got : got + n]
                got += have
        bits >>= 1
        if not bits:
            break
        n = len(h) - have
        h = h[:n] * p + h[have : have + n]
        p = p * p
        have *= 2
    return mix(out[: len(data) - k + 1])


def window_min(h: np.ndarray, w: int) -> np.ndarray:
    """The minimum of the ``w`` values from each position on."""
    have, m = 1, h
    while have < w:
        step = min(have, w - have)
        m = np.minimum(m[: len(m) - step], m[step:])
        have += step
    return m


#: Bytes that stand for a space in ``split``, of texts whose words are what is not ASCII white space.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True
#: Each byte as it stands in a term: A-Z lower-cased, a space where no term is.
_TERM = np.where(_WORD, _LOWER, np.uint8(0x20))


def split(column: pa.Array, limit: int = CHUNK, terms: bool = False):
    """(first row, words, first word of each text and the end, texts) of runs of rows; a null text is an empty one.

    Words are runs of other than ASCII white space; with ``terms`` runs of ASCII letters and digits and all
    beyond ASCII, A-Z lower-cased.
    """
    for a, data, offs in chunks(column, limit):
        body = _TERM[data] if terms else np.ascontiguousarray(data)
        texts = pa.LargeStringArray.from_buffers(len(offs) - 1, pa.py_buffer(np.ascontiguousarray(offs)), pa.py_buffer(body))
        lists = pc.ascii_split_whitespace(texts)
        flat, at = lists.values, lists.offsets.to_numpy()
        there = np.asarray(pc.binary_length(flat)) > 0
        if not there.all():
            at = np.concatenate([[0], np.cumsum(there)])[at]
            flat = flat.filter(pa.array(there))
        yield a, flat, at.astype(np.int64), texts


def codes(words: pa.Array) -> np.ndarray:
    """A number for each word, equal for equal words."""
    return np.asarray(words.dictionary_encode().indices).astype(np.int64)


def owners(at: np.ndarray) -> np.ndarray:
    """The text of each word, given the first word of each text and the end."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))
