"""Quality rules: counted text rules, and a calibrated classifier over hashed word and character n-grams.

The classifier is logistic regression on two hashed blocks of features, the words of a text and its
byte 4-grams, each block scaled to sum to one. It is trained on labelled quality rows, calibrated by
Platt scaling on rows it did not see, and scored in Arrow batches against a fixed threshold.

Defined results: a null or empty text has no words, fails the base rule and is not kept. With no
labelled row, or labels of one class only, the classifier keeps everything. A document whose labels
disagree is not used for training; of rows that share a doc_id one is. Repeated rows are judged each. A text
of any length is read whole. A probability at the threshold keeps its document. An empty table has an empty
result. Extra columns are ignored or, in ``filter_documents``, carried along whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import SPACE, U, VALUE_EXACT, Words, chunks, mixed, span_hashes, tidy, utf8, windows
from .scratch import released, shrunk

#: Labelled rows that training reads at most, taken in the order of a hash of doc_id.
MAX_TRAIN_ROWS = 3000
BITS = 15
#: A document goes if its calibrated probability of good quality is below this.
KEEP_AT = 0.5
MIN_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, p_good double, kept boolean"


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.float64 if flags.dtype.kind == "f" else np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def rule_counts(w: Words) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    raw, offsets, n = w.raw, w.offsets, len(w.offsets) - 1
    out = {"n_words": np.diff(w.off), "word_chars": _per_text(((raw & 0xC0) != 0x80) & ~SPACE[raw], offsets), "n_symbols": _per_text(SYMBOLS[raw], offsets)}

    breaks = np.flatnonzero(raw == 10)
    starts = np.union1d(offsets[:-1], breaks + 1)
    starts = starts[starts < len(raw)]
    text_of = np.searchsorted(offsets, starts, "right") - 1
    ends = np.minimum(np.append(breaks, len(raw))[np.searchsorted(breaks, starts)], offsets[text_of + 1])
    some = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    starts, ends, text_of = starts[some], ends[some], text_of[some]
    order = np.lexsort((h := span_hashes(raw, starts, ends), text_of))
    h, t = h[order], text_of[order]
    again = (h[1:] == h[:-1]) & (t[1:] == t[:-1])
    out["n_dup_lines"] = np.bincount(t[1:][again], minlength=n)

    runs, at = windows(w.hashes(VALUE_EXACT), w.doc, WINDOW)
    key = mixed(runs + w.doc[at].astype(U) * U(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    change = np.zeros(len(w.starts) + 1, np.int64)
    np.add.at(change, at[twice], 1)
    np.add.at(change, at[twice] + WINDOW, -1)
    out["n_repeat_words"] = _per_text(np.cumsum(change[:-1]) > 0, w.off)
    return out


def feature_ids(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed ids of the words, of the byte 4-grams, and where each text's 4-grams begin."""
    words = (w.hashes(VALUE_EXACT) >> U(64 - BITS)).astype(np.int64)
    raw, offsets = w.raw.astype(np.uint32), w.offsets
    if len(raw) < 4:
        return words, np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    code = raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16 | raw[3:] << 24
    grams = ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64)
    inside = np.ones(len(grams), bool)
    for j in (1, 2, 3):
        cut = offsets[1:-1] - j
        inside[cut[(cut >= 0) & (cut < len(grams))]] = False
    begins = np.concatenate(([0], np.cumsum(inside)))[np.minimum(offsets, len(grams))]
    return words, grams[inside], begins


class Model:
    """Weights of both blocks and the calibration; ``weights`` is None if nothing could be learnt."""

    def __init__(self, weights: np.ndarray | None, bias: float = 0.0, slope: float = 1.0, shift: float = 0.0):
        self.weights, self.bias, self.slope, self.shift = weights, bias, slope, shift

    def logits(self, w: Words) -> np.ndarray:
        words, grams, begins = feature_ids(w)
        size = 1 << BITS
        out = np.full(len(w.offsets) - 1, self.bias)
        for at, ids, off in ((0, words, w.off), (size, grams, begins)):
            out += _per_text(self.weights[at : at + size][ids], off) / np.maximum(np.diff(off), 1)
        return out

    def probability(self, w: Words) -> np.ndarray:
        if self.weights is None:
            return np.ones(len(w.offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(w) + self.shift, -500, 500)))


@tidy
def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        w = Words(*utf8(batch.column(1)))
        words, grams, begins = feature_ids(w)
        ids, values = [], []
        for d in range(batch.num_rows):
            parts = [np.unique(x, return_counts=True) for x in (words[w.off[d] : w.off[d + 1]], grams[begins[d] : begins[d + 1]])]
            ids.append(np.concatenate([p[0] + (k << BITS) for k, p in enumerate(parts)]).astype(np.int32).tobytes())
            values.append(np.concatenate([p[1] / max(p[1].sum(), 1) for p in parts]).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(ids, pa.binary()), pa.array(values, pa.binary())], ["doc_id", "good", "ids", "vals"])


class Sample:
    """Labelled rows as sparse features, in slices of few rows, so that what a step makes besides the weights is small."""

    SLICE = 128

    def __init__(self, rows: pa.Table):
        self.good = rows.column("good").to_numpy().astype(np.float64)
        self.slices = []
        for at in range(0, rows.num_rows, self.SLICE):
            part = rows.slice(at, self.SLICE)
            ids, values = ([np.frombuffer(x, kind) for x in part.column(name).to_pylist()] for name, kind in (("ids", np.int32), ("vals", np.float32)))
            self.slices.append((at, at + len(ids), np.concatenate(ids), np.concatenate(values), np.repeat(np.arange(len(ids)), [len(x) for x in ids])))

    def logits(self, weights: np.ndarray, bias: float) -> np.ndarray:
        out = np.full(len(self.good), bias)
        for lo, hi, col, val, row in self.slices:
            out[lo:hi] += np.bincount(row, weights[col] * val, hi - lo)
        return out

    def gradient(self, err: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(size)
        for lo, hi, col, val, row in self.slices:
            out += np.bincount(col, err[lo:hi][row] * val, size)
        return out


def labelled(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(doc_id, text, good) of at most ``max_rows`` documents, one row for each doc_id: of several texts the one of the smallest hash."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("lo"), F.max("quality").alias("hi")).where("lo = hi")
    known = known.select("doc_id", (F.col("lo") == 1).cast("int").alias("good"), F.xxhash64("doc_id").alias("r")).orderBy("r", "doc_id").limit(max_rows)
    pairs = docs.select("doc_id", "text").join(F.broadcast(known.select("doc_id", "good")), "doc_id")  # max_rows bounds this side
    return pairs.groupBy("doc_id", "good").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "good")


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS, steps: int = 150, l2: float = 1e-6) -> Model:
    """Fits on at most ``max_rows`` labelled documents; a fourth of them only serves the calibration.

    The driver holds the hashed features of the sample, which are at most max_rows * 2**(BITS + 1) numbers and a few MB
    in texts of ordinary length, and goes over them in slices."""
    shrunk(docs.sparkSession)
    rows = labelled(docs, labels, max_rows).mapInArrow(_examples, "doc_id long, good int, ids binary, vals binary").toArrow().sort_by("doc_id")
    sample = Sample(rows)
    del rows
    good = sample.good
    if len(set(good.tolist())) < 2:
        return Model(None)
    held = np.arange(len(good)) % 4 == 3
    if len(set(good[held].tolist())) < 2 or len(set(good[~held].tolist())) < 2:
        held[:] = False
    weights, bias, use = np.zeros(2 << BITS), 0.0, ~held
    weight_of = np.where(good == 1, 0.5 / max(1, (good[use] == 1).sum()), 0.5 / max(1, (good[use] == 0).sum())) * use
    m, v, mb, vb = np.zeros_like(weights), np.zeros_like(weights), 0.0, 0.0
    for t in range(1, steps + 1):  # Adam on the whole sample
        err = (1 / (1 + np.exp(-sample.logits(weights, bias))) - good) * weight_of
        g, gb = sample.gradient(err, len(weights)) + l2 * weights, err.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        a, b = 1 - 0.9**t, 1 - 0.99**t
        weights -= 1.0 * (m / a) / (np.sqrt(v / b) + 1e-8)
        bias -= 0.1 * (mb / a) / (np.sqrt(vb / b) + 1e-8)
    logits = sample.logits(weights, bias)
    z, y = (logits[held], good[held]) if held.any() else (logits, good)
    slope, shift = 1.0, 0.0
    y = np.where(y == 1, ((y == 1).sum() + 1) / ((y == 1).sum() + 2), 1 / ((y == 0).sum() + 2))  # Platt's targets
    for _ in range(50):
        p = 1 / (1 + np.exp(-(slope * z + shift)))
        d, h = p - y, p * (1 - p) + 1e-9
        hess = np.array([[(h * z * z).sum() + 1e-6, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-6]])
        move = np.linalg.solve(hess, [(d * z).sum(), d.sum()])
        slope, shift = max(1e-3, slope - np.clip(move[0], -1, 1)), shift - np.clip(move[1], -1, 1)
    del sample
    released(docs.sparkSession)
    return Model(weights, bias, slope, shift)


def judge(docs: DataFrame, model: Model, keep_at: float = KEEP_AT) -> DataFrame:
    """The rule counts, the calibrated probability and the verdict of every document."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2 * 2**BITS weights

    @tidy
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in chunks(batches):
            w = Words(*utf8(batch.column(1)))
            c = rule_counts(w)
            failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > REPEAT_PERCENT * c["n_words"])
            p = m.probability(w)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in c.values()), pa.array(failed), pa.array(p), pa.array(~failed & (p >= keep_at))], ["doc_id", *c, "base_failed", "p_good", "kept"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, SCHEMA)


def filter_documents(docs: DataFrame, model: Model, keep_at: float = KEEP_AT) -> DataFrame:
    """The documents that are kept, with their columns as they were."""
    names, schema = docs.columns, docs.schema
    held = docs.sparkSession.sparkContext.broadcast(model)

    @tidy
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in chunks(batches):
            w = Words(*utf8(batch.column(at)))
            c = rule_counts(w)
            failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > REPEAT_PERCENT * c["n_words"])
            yield batch.filter(pa.array(~failed & (held.value.probability(w) >= keep_at)))

    return docs.mapInArrow(keep, schema)
