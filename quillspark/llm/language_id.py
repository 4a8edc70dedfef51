"""Language ID with a string kernel: n-gram presence, Nystroem landmarks, kernel ridge regression."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table
from .textkit import U, chunks, mix

#: Blended spectrum: presence of the byte n-grams of these lengths, hashed into BUCKETS.
LENGTHS = (1, 2, 3, 4)
BUCKETS = 1 << 15
#: Labelled texts that the model is fitted on, per language and altogether, and landmarks among them.
PER_LANGUAGE, MOST_TEXTS, LANDMARKS = 200, 4000, 256
RIDGE = 1e-2
#: Texts with less evidence than this are rejected by ``accepted``.
REJECT_BELOW = 0.25
#: Evidence of a longer text is that of its parts of so many bytes, if it is more: a text may be in several languages.
PART = 1 << 12
_WORDY = re.compile(r"[^\W\d_]")
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32
_FOLD[0x30:0x3A] = 0x30
_FOLD[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 0x20


def has_letter(text: str) -> bool:
    """Whether a character of category L is there; numerals such as a half or a Roman one are none."""
    return any(m[0].isalpha() for m in _WORDY.finditer(text))


def present(data: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """The buckets of the n-grams that a text holds, ascending. ``flags`` is scratch of BUCKETS zeros.

    A-Z are lower-cased, digits are one symbol, other ASCII is a space; each end of the text is one too.
    """
    x = np.concatenate([[0x20], _FOLD[data], [0x20]]).astype(np.uint32)
    code = np.zeros(len(x), np.uint32)
    for n in range(1, max(LENGTHS) + 1):
        code = code[: len(x) - n + 1] * np.uint32(256) + x[n - 1 :]
        if not len(code):
            break
        if n in LENGTHS:
            h = (code + np.uint32(n * 0x1ED270B)) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x85EBCA6B)
            flags[h >> np.uint32(17)] = True
    found = np.flatnonzero(flags)
    flags[found] = False
    return found


def _features(batches):
    flags = np.zeros(BUCKETS, bool)
    for batch in batches:
        out = []
        for _, data, offs in chunks(batch.column("text")):
            for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                bits = np.zeros(BUCKETS, bool)
                bits[present(data[a:b], flags)] = True
                out.append(np.packbits(bits).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(out, pa.binary())], ["lang", "bits"])


class Model:
    """``labels``, the weight of each bucket for each label, and what evidence is measured by.

    ``seen`` marks the buckets that a label's texts hold; a text's coverage is the share of its own
    among them. ``alien`` and ``clean`` are the coverages that stand for evidence 0 and 1.
    """

    def __init__(self, labels: list[str], weights: np.ndarray, bias: np.ndarray, seen: np.ndarray, alien: np.ndarray, clean: np.ndarray):
        self.labels, self.weights, self.bias = labels, weights, bias
        self.seen, self.alien, self.clean = seen, alien, clean

    def product(self, has: list[np.ndarray], evidence: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """Unit presence rows of texts times the weights, and the texts' coverage by each label.

        The rows are sparse (``has`` lists the buckets of each text, at least one), so the
        product is a gather of all their buckets' weights and a sum over each row's stretch.
        """
        size = np.array([len(h) for h in has])
        which, begin = np.concatenate(has), np.cumsum(size) - size
        rows = np.add.reduceat(self.weights[which].astype(np.float64), begin, axis=0) / np.sqrt(size)[:, None]
        return rows, np.add.reduceat(self.seen[which].astype(np.float64), begin, axis=0) / size[:, None] if evidence else None


    def evidence(self, coverage: float, k: int) -> float:
        """Where a coverage by label ``k`` lies between strange and clean texts, 0 to 1."""
        span = self.clean[k] - self.alien[k]
        return float(min(max((coverage - self.alien[k]) / span, 0.0), 1.0)) if span > 0 else 1.0

    def parts_evidence(self, data: np.ndarray, flags: np.ndarray) -> float:
        """The mean evidence of a text's parts of about PART bytes, each for its own best label."""
        cuts = np.linspace(0, len(data), -(-len(data) // PART) + 1).astype(int)
        has = [present(data[a:b], flags) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        rows, cover = self.product(has, True)
        best = (rows + self.bias).argmax(axis=1)
        return float(np.mean([self.evidence(cover[i, k], k) for i, k in enumerate(best)]))


def fit(labels: list[str], bits: list[bytes], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """One-versus-rest kernel ridge regression in the Nystroem space of some of the texts.

    The kernel is the cosine of presence vectors, k(x, z) = |x & z| / sqrt(|x| |z|). With the
    landmarks' P (unit rows) the features of x are k(x, landmarks) W^-1/2; a ridge solution b gives
    the score k(x, landmarks) W^-1/2 b. Since k is linear in the presence vector, P^T W^-1/2 b is
    one weight per bucket, and a batch of texts is scored by a product of matrices.

    The scores of a text sum to one over the labels, so the best of them says nothing of whether the
    text is in any of these languages; its coverage by the label's texts does, see ``_evidence``.
    """
    x = np.unpackbits(np.frombuffer(b"".join(bits), np.uint8).reshape(len(bits), -1), axis=1).astype(np.float32)
    x /= np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
    names = sorted(set(labels))
    y = np.array([[1.0 if label == name else 0.0 for name in names] for label in labels])
    # landmarks by turns from every language, in the order given
    seen: dict[str, int] = {}
    turn = []
    for i, label in enumerate(labels):
        turn.append((seen.get(label, 0), i))
        seen[label] = seen.get(label, 0) + 1
    p = x[[i for _, i in sorted(turn)[:landmarks]]]
    w, v = np.linalg.eigh((p @ p.T).astype(np.float64))
    good = w > 1e-6 * w[-1]
    root = v[:, good] / np.sqrt(w[good])
    phi = (x @ p.T) @ root
    mean, centre = y.mean(axis=0), phi.mean(axis=0)
    each = 1.0 / (y.sum(axis=0)[y.argmax(axis=1)])  # languages weigh alike
    each *= len(y) / each.sum()
    a = (phi - centre) * each[:, None]
    b = np.linalg.solve((phi - centre).T @ a + ridge * np.eye(phi.shape[1]), a.T @ (y - mean))
    return Model(names, (p.T @ (root @ b)).astype(np.float32), mean - centre @ b, *_evidence(x, y))


def _evidence(x: np.ndarray, y: np.ndarray):
    """What each label's texts hold, and the coverage of strange and of clean texts by it.

    Clean is what 99 of 100 of the label's texts reach, each by the others; strange is the mean of the
    texts of other labels, or of random buckets if that is more. Where the two are not apart, or
    there is no other text, strange is 0, so that a language with few texts rejects the less.
    """
    held = (x > 0).astype(np.float32)
    often = y.T.astype(np.float32) @ held
    size = np.maximum(held.sum(axis=1, keepdims=True), 1)
    by_any, by_others = held @ (often > 0).T / size, held @ (often > 1).T / size
    alien, clean = np.zeros(y.shape[1]), np.zeros(y.shape[1])
    for k in range(y.shape[1]):
        own = y[:, k] > 0
        clean[k] = np.quantile(by_others[own, k], 0.01)
        alien[k] = max((often[k] > 0).mean(), by_any[~own, k].mean() if (~own).any() else 0.0)
    return (often > 0).T.astype(np.float32), np.where(alien < clean, alien, 0.0), clean


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", per_language: int = PER_LANGUAGE, most: int = MOST_TEXTS) -> Model | None:
    """A model of a bounded sample of the labelled rows: the ``per_language`` texts of least hash
    per label, ``most`` at most, whole. None if there is no label."""
    spread = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), spread.alias("h"), F.col(id_col).cast("string").alias("i"))
    # first the ids alone are ranked; only chosen texts are kept, repeated rows once
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "i"))
    keys = labelled.select("lang", "h", "i").withColumn("r", rank).where(F.col("r") <= per_language).orderBy("r", "lang").limit(most)
    keys = keys.groupBy("lang", "h", "i").agg(F.min("r").alias("r"))
    chosen = labelled.withColumn("i", F.coalesce("i", F.lit(""))).join(F.broadcast(keys.withColumn("i", F.coalesce("i", F.lit("")))), ["lang", "h", "i"]).dropDuplicates(["lang", "h", "i"])
    rows = chosen.select("text", F.concat_ws("\x00", F.format_string("%09d", "r"), F.col("lang"), F.col("i"), F.col("h").cast("string")).alias("lang")).mapInArrow(_features, "lang string, bits binary").collect()
    if not rows:
        return None
    rows = sorted({r["lang"]: r["bits"] for r in rows}.items())
    return fit([k.split("\x00")[1] for k, _ in rows], [v for _, v in rows])


def _predict(model: Model | None, evidence: bool):
    def run(batches):
        flags = np.zeros(BUCKETS, bool)
        for batch in batches:
            lang, score, sure = [], [], []
            texts = batch.column("text")
            for row, data, offs in chunks(texts):
                known = np.array([bool(model and b > a and has_letter(texts[row + i].as_py())) for i, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True))])
                has = [present(data[offs[i] : offs[i + 1]], flags) for i in np.flatnonzero(known)]
                x, cover, parts = np.zeros((len(known), len(model.labels) if model else 1)), None, {}
                if has:
                    x[known], covered = model.product(has, evidence)
                    if evidence:
                        cover = np.zeros_like(x)
                        cover[known] = covered
                        parts = {int(i): model.parts_evidence(data[offs[i] : offs[i + 1]], flags) for i in np.flatnonzero(known) if offs[i + 1] - offs[i] > PART}
                s = x + (model.bias if model else 0)
                best = s.argmax(axis=1)
                for i, ok in enumerate(known.tolist()):
                    lang.append(model.labels[best[i]] if ok else "und")
                    score.append(float(min(max(s[i, best[i]], 0.0), 1.0)) if ok else 0.0)
                    if evidence:
                        k = best[i]
                        sure.append(max(model.evidence(cover[i, k], k), parts.get(i, 0.0)) if ok else 0.0)
            rest = [batch.column(c) for c in batch.schema.names if c != "text"]
            more = {"lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64())} | ({"evidence": pa.array(sure, pa.float64())} if evidence else {})
            yield pa.RecordBatch.from_arrays([*rest, *more.values()], [*(c for c in batch.schema.names if c != "text"), *more])

    return run


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", keep: list | None = None, evidence: bool = False) -> DataFrame:
    """``lang_pred`` and ``score`` (0 to 1) of every whole text, from the text alone.

    Null texts and those without a letter are ``und`` with score 0, and so are all if there is no
    model. ``keep`` names the columns that stay beside them. ``evidence`` adds a column of that name, 0 to 1:
    where the text's coverage by the predicted language lies between strange and clean texts, or its parts'
    by theirs, if the text is long and that is more.
    """
    keep = list(keep or [])
    base = docs.select(*keep, F.col(text_col).alias("text"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields if f.name != "text"]
    return base.mapInArrow(_predict(model, evidence), ", ".join([*kinds, "lang_pred string", "score double", *["evidence double"] * evidence]))


def held_out(doc_id):
    """Documents that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", below: float = REJECT_BELOW) -> DataFrame:
    """``docs`` without what has no language: ``und``, or evidence under ``below``. Columns stay."""
    model = train(docs.where(~held_out(F.col(id_col))), lang_col, text_col, id_col)
    # all columns go through the batches under names of their own, so nothing has to be joined back
    held = {c: f"_c{k}" for k, c in enumerate(docs.columns)}
    plain = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in held.items()))
    scored = predict(plain, model, next(n for c, n in held.items() if c.lower() == text_col.lower()), list(held.values()), evidence=True)
    kept = scored.where((F.col("lang_pred") != "und") & (F.col("evidence") >= below))
    return kept.select(*(F.col(n).alias(c) for c, n in held.items()))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model, keep=["doc_id", "held_out"])
