"""Toxicity by multiple-instance learning: sentences are instances, documents carry the labels."""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column_at, give_back, slices

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w+")
#: Labelled rows and characters that a fit reads at most; no text is over a tenth of the latter.
MAX_FIT_ROWS, MAX_FIT_CHARS = 6_000, 40_000_000
PREFIXES = (4, 5, 6, 7, 8)
CACHE_WORDS = 300_000
THRESHOLD = 0.3


def features(word: str) -> list[int]:
    """32-bit hashes of a word and of its beginnings, which ``^`` marks."""
    names = [word] + ["^" + word[:k] for k in PREFIXES if len(word) >= k]
    return [zlib.crc32(n.encode("utf-8", "surrogatepass")) for n in names]


def sentences(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """``(start, end, distinct words)`` of each sentence that has a word, in code points."""
    for m in SENTENCE.finditer(text):
        words = WORD.findall(m.group().lower())
        if words:
            yield m.start(), m.end(), list(dict.fromkeys(words))


class NoisyOr:
    """Document score ``1 - prod(1 - sigmoid(bias + sum of word weights))`` over its sentences.

    ``slope`` and ``shift``, if given, calibrate it: the sigmoid of ``slope log(-log(1 - p)) + shift``.
    """

    def __init__(self, bias: float, weights: dict[int, float], slope: float | None = None, shift: float = 0.0):
        self.bias, self.weights, self.slope, self.shift = bias, weights, slope, shift

    @property
    def parts(self) -> tuple:
        return self.bias, self.weights, self.slope, self.shift

    @classmethod
    def calibrated(cls, rows: list[tuple[str, int]], every: int = 5, clean: float = 3.0, **options) -> NoisyOr:
        """Fit on four fifths of the rows and calibrate on the others, where both labels occur.

        ``clean`` is the weight of label 0 there: a clean text called toxic costs more than the reverse.
        """
        held = [r for k, r in enumerate(rows) if k % every == every - 1]
        model = cls.fit([r for k, r in enumerate(rows) if k % every != every - 1], **options)
        cache: dict[int, float] = {}
        x = np.array([math.log(max(model.evidence(t, cache)[0], 1e-9)) for t, _ in held])
        y = np.array([v for _, v in held], float)
        if not model.weights or not 0 < y.sum() < len(y):
            return model
        a, b, n = 1.0, 0.0, np.where(y > 0, 1.0, clean)
        for _ in range(50):  # Newton steps, drawn slightly to slope 1 and shift 0
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
            g = np.array([(n * (p - y) * x).sum() + (a - 1), (n * (p - y)).sum() + 0.1 * b])
            h = n * p * (1 - p) + 1e-9
            step = np.linalg.solve(np.array([[(h * x * x).sum() + 1, (h * x).sum()], [(h * x).sum(), h.sum() + 0.1]]), g)
            a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -2, 2))
        return cls(model.bias, model.weights, max(a, 0.1), b)

    @classmethod
    def fit(cls, rows: list[tuple[str, int]], steps: int = 150, rate: float = 0.1, l2: float = 0.5, min_docs: int = 5, positive: float = 2.0) -> NoisyOr:
        """Gradient descent (Adam) on the cross entropy of document labels; ``rows``: (text, 0/1).

        ``positive`` is the weight of label 1, ``l2`` the penalty in documents, ``min_docs`` the
        documents that a feature must be seen in.
        Without rows of both labels the model is a constant: the share of label 1.
        """
        y = np.array([t for _, t in rows], float)
        share = float(y.mean()) if len(y) else 0.0
        if not 0 < share < 1:
            return cls(math.log((share + 1e-3) / (1 - share + 1e-3)), {})
        vocab: dict[str, int] = {}
        cells = [array("i") for _ in range(3)]  # compact: the driver's memory is small
        cell_word, cell_sent, sent_doc = cells
        for d, (text, _) in enumerate(rows):
            for _, _, words in sentences(text):
                cell_word.extend([vocab.setdefault(w, len(vocab)) for w in words])
                cell_sent.extend([len(sent_doc)] * len(words))
                sent_doc.append(d)
        cell_word, cell_sent, sent_doc = (np.array(x, np.int32) for x in cells)
        fw, code = array("i"), array("I")
        for w, k in vocab.items():
            own = features(w)
            fw.extend([k] * len(own))
            code.extend(own)
        fw, (names, ff) = np.array(fw, np.int32), np.unique(np.array(code, np.uint32), return_inverse=True)
        del code, cells
        # features seen in a few documents only are noise
        pairs = np.unique(cell_word.astype(np.int64) * len(rows) + sent_doc[cell_sent])
        docs_of_word = np.bincount(pairs // len(rows), minlength=len(vocab))
        del pairs
        seen_in = np.bincount(ff, docs_of_word[fw], len(names))
        keep = seen_in[ff] >= min_docs
        fw, ff = fw[keep], ff[keep].astype(np.int32)
        n_docs, n_sent, n_word, n_feat = len(rows), len(sent_doc), len(vocab), len(names)
        w, b = np.zeros(n_feat), -5.0
        m, v, mb, vb = np.zeros(n_feat), np.zeros(n_feat), 0.0, 0.0
        for t in range(1, steps + 1):
            word_w = np.bincount(fw, w[ff], n_word)
            z = b + np.bincount(cell_sent, word_w[cell_word], n_sent)
            s = np.bincount(sent_doc, np.logaddexp(0, z), n_docs)
            keep_p = np.exp(-s)
            ds = (1 - y) - positive * y * keep_p / np.maximum(1 - keep_p, 1e-9)
            dz = ds[sent_doc] / (1 + np.exp(-z)) / n_docs
            g_word = np.bincount(cell_word, dz[cell_sent], n_word)
            g = np.bincount(ff, g_word[fw], n_feat) + l2 * w / n_docs
            gb = dz.sum()
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            c1, c2 = 1 - 0.9**t, 1 - 0.999**t
            w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-6)
            b -= rate * (mb / c1) / (math.sqrt(vb / c2) + 1e-9)
        return cls(float(b), {int(names[k]): float(w[k]) for k in np.flatnonzero((np.abs(w) > 1e-4) & (seen_in >= min_docs))})

    def word_weight(self, word: str) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in features(word))

    def evidence(self, text: str, cache: dict[str, float]) -> tuple[float, float, int, int]:
        """``-log(1 - p)`` of the text, and the log odds and span of its worst sentence."""
        total, worst, span = 0.0, -math.inf, (0, 0)
        for start, end, words in sentences(text):
            z = self.bias
            for w in words:
                x = cache.get(w)
                if x is None:
                    if len(cache) >= CACHE_WORDS:
                        cache.clear()
                    cache[w] = x = self.word_weight(w)
                z += x
            total += max(z, 0.0) + math.log1p(math.exp(-abs(z)))
            if z > worst:
                worst, span = z, (start, end)
        return total, worst, *span

    def score(self, text: str, cache: dict[str, float]) -> tuple[float, int, int, float]:
        """``(score, start, end, sentence score)``; the last three are of the worst sentence."""
        total, worst, start, end = self.evidence(text, cache)
        if worst == -math.inf:
            return 0.0, 0, 0, 0.0
        sentence = 1 / (1 + math.exp(-max(worst, -700)))
        if self.slope is None:
            return -math.expm1(-total), start, end, sentence
        z = self.slope * math.log(max(total, 1e-300)) + self.shift
        return 1 / (1 + math.exp(-max(z, -700))), start, end, sentence


def fit(docs: DataFrame, labels: DataFrame, learn=None, max_rows: int = MAX_FIT_ROWS, max_chars: int = MAX_FIT_CHARS) -> NoisyOr:
    """Fit on at most ``max_rows`` labelled documents, those with the smallest hash of their id.

    ``learn``: a condition on ``doc_id`` that labels must meet to be read.  Null labels and null
    ids are no labels, nor are labels without a document; of several labels of one id the largest
    counts; a null text is empty.  Rows that repeat an id and a text are one; several texts of an id
    are as many rows.  The rows are cut to ``max_rows`` and ``max_chars`` before they leave the executors.
    """
    ids = labels.where("doc_id is not null and toxic is not null")
    ids = ids.where(learn) if learn is not None else ids
    ids = ids.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).join(docs.select("doc_id"), "doc_id", "left_semi")
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)  # so many rows at most, hence fit to broadcast
    rows = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .join(F.broadcast(ids), "doc_id")
        .where(F.length("text") <= max_chars // 10)
        .select("doc_id", "text", (F.col("toxic") > 0).cast("int").alias("toxic"))
        .dropDuplicates(["doc_id", "text"])
        .orderBy(F.xxhash64("doc_id", "text"))
        .limit(max_rows)
    )
    before = F.sum(F.length("text")).over(Window.orderBy(F.xxhash64("doc_id", "text"), "doc_id"))  # over so many rows at most
    rows = [tuple(r) for r in rows.withColumn("before", before).where(F.col("before") <= max_chars).drop("before").collect()]
    rows = [t[1:] for t in sorted(rows)]
    return NoisyOr.calibrated(rows)


def score(docs: DataFrame, model: NoisyOr, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score whole texts: ``id, score, worst_start, worst_end, worst_score``.

    A null, empty or wordless text scores 0 with the span (0, 0).  One row per input row.
    """
    held = docs.sparkSession.sparkContext.broadcast(model.parts)  # bounded by the fit's sample
    idt = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, cache = NoisyOr(*held.value), {}
        for b in (s for whole in batches for s in slices(whole, 1)):
            out = [m.score(t or "", cache) for t in b.column(1).to_pylist()]
            cols = list(zip(*out)) or [(), (), (), ()]
            kinds = (pa.float64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]],
                names=["id", "score", "worst_start", "worst_end", "worst_score"],
            )

    picked = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return picked.mapInArrow(run, f"id {idt}, score double, worst_start long, worst_end long, worst_score double")


def held_out(k: int, of: int, name: str = "doc_id"):
    """True where crc32 of the id as text leaves remainder ``k``; false for null ids."""
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % of == k, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the rows that are not held out (remainder 2 of 4) and score all documents."""
    model = fit(docs, labels, learn=~held_out(2, 4))
    return score(docs, model).select(
        F.col("id").alias("doc_id"),
        held_out(2, 4, "id").alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "worst_start",
        "worst_end",
        "worst_score",
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is under the threshold, with their own columns.

    The decision is made row by row in the scan, so no join moves the texts; repeated rows go alike.
    """
    model = fit(docs, labels, learn=~held_out(2, 4))
    held = docs.sparkSession.sparkContext.broadcast(model.parts)
    at = column_at(docs, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, cache = NoisyOr(*held.value), {}
        for b in (s for whole in batches for s in slices(whole, at)):
            ok = [m.score(t or "", cache)[0] < THRESHOLD for t in b.column(at).to_pylist()]
            yield b.filter(pa.array(ok, pa.bool_()))
        cache.clear()
        del m
        give_back()

    return docs.mapInArrow(run, docs.schema)
