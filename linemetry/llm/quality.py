"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

score = sigmoid(w0 + sum w_i x_i + sum over pairs of <v_i, v_j> x_i x_j). The pairs' sum is found in
linear time: half of the sum over dimensions of (sum v_i x_i)^2 - sum (v_i x_i)^2.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _words
from ._memory import release, tidied

#: Word buckets, dimensions, and labelled rows to learn from at most (the smallest hashes).
BUCKETS, DIMENSIONS, SAMPLE_ROWS = 1 << 13, 8, 8192
EPOCHS, STEP, RATE, DECAY, SEED = 16, 128, 0.1, 2e-5, 20240607
STATISTICS = ("words", "bytes_per_word", "upper", "digit", "mark", "symbol", "wide", "break", "distinct", "repeat", "shout", "short_line", "n_chars")


@dataclass
class Features:
    """Of the documents first..stop of a batch: (doc, bucket, value) of words, and statistics."""

    first: int
    stop: int
    doc: np.ndarray
    bucket: np.ndarray
    value: np.ndarray
    statistics: np.ndarray


_KIND = np.zeros(256, dtype=np.uint8)  # 1 upper, 2 digit, 3 mark, 4 symbol, 5 not ASCII, 6 line break
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[[ord(c) for c in ".,;:'\"()-?"]] = 3
_KIND[[ord(c) for c in "!#$%&*+/<=>@[]\\^_`{|}~"]] = 4
_KIND[128:] = 5
_KIND[10] = 6


def features(texts: pa.Array, n_chars: np.ndarray) -> Iterator[Features]:
    for w in _words.slices(texts, lower=False):
        m = w.stop - w.first
        size = np.maximum(np.diff(w.offsets), 1).astype(np.float64)
        words = np.maximum(w.counts, 1).astype(np.float64)
        kind = _KIND[w.data]
        total = np.zeros(len(kind) + 1)
        shares = []
        for k in range(1, 7):
            np.cumsum(kind == k, out=total[1:])
            shares.append((total[w.offsets[1:]] - total[w.offsets[:-1]]) / size)
        of = lambda x: np.bincount(w.doc, weights=x, minlength=m)
        last = w.data[np.maximum(w.end - 1, 0)] if len(w.end) else np.zeros(0, np.uint8)
        again = np.zeros(len(w.hash))
        again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
        key = w.doc.astype(np.uint64) << np.uint64(52) | w.hash >> np.uint64(12)
        key, times = np.unique(key, return_counts=True)
        doc = (key >> np.uint64(52)).astype(np.int64)
        shares[5] = np.minimum(shares[5] * 20, 3)
        statistics = np.stack([
            np.log1p(w.counts), of(w.end - w.start) / words, *shares, np.bincount(doc, minlength=m) / words, of(again) / words,
            of(_KIND[last] == 4) / words if len(last) else np.zeros(m), np.log1p(w.counts) * shares[5], np.log1p(np.maximum(n_chars[w.first : w.stop], 0)),
        ], axis=1)
        bucket = ((key & np.uint64((1 << 52) - 1)) % np.uint64(BUCKETS)).astype(np.int64)
        # words that meet in a bucket add up
        joint, at = np.unique(doc * BUCKETS + bucket, return_inverse=True)
        value = np.log1p(np.bincount(at, weights=times))
        doc, bucket = joint // BUCKETS, joint % BUCKETS
        norm = np.sqrt(np.bincount(doc, weights=value * value, minlength=m))
        yield Features(w.first, w.stop, doc, bucket, value / norm[doc], statistics)


@dataclass
class Machine:
    """Weights and factors of buckets, then of statistics; and the statistics' scale."""

    bias: float
    weight: np.ndarray
    factor: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def scaled(self, statistics: np.ndarray) -> np.ndarray:
        return np.clip((statistics - self.mean) / self.spread, -4, 4) * 0.5

    def terms(self, f: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows (doc, feature, value), the statistics after the words."""
        m, k = f.statistics.shape
        doc = np.concatenate([f.doc, np.repeat(np.arange(m), k)])
        return doc, np.concatenate([f.bucket, BUCKETS + np.tile(np.arange(k), m)]), np.concatenate([f.value, self.scaled(f.statistics).ravel()])

    def margin(self, doc: np.ndarray, feature: np.ndarray, value: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Margins, and sums of v x by document and dimension. doc needn't be sorted."""
        vx = self.factor[feature] * value[:, None]
        order = np.argsort(doc, kind="stable")
        heads = np.searchsorted(doc[order], np.arange(m))
        sums = np.add.reduceat(vx[order], heads, axis=0)  # every document has its statistics
        squares = np.add.reduceat((vx * vx)[order], heads, axis=0)
        linear = np.bincount(doc, weights=self.weight[feature] * value, minlength=m)
        return self.bias + linear + 0.5 * (sums * sums - squares).sum(axis=1), sums


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray) -> Machine:
    """Learn from rows (buckets, values, statistics) by AdaGrad on the logistic loss."""
    rng = np.random.default_rng(SEED)
    statistics = np.stack([r[2] for r in rows]) if rows else np.zeros((1, len(STATISTICS)))
    n = BUCKETS + len(STATISTICS)
    rate = float(np.clip(labels.mean() if len(labels) else 0.5, 0.01, 0.99))
    machine = Machine(float(np.log(rate / (1 - rate))), np.zeros(n), rng.normal(0, 0.02, (n, DIMENSIONS)), statistics.mean(axis=0), statistics.std(axis=0) + 1e-6)
    if len(set(labels.tolist())) < 2:
        return machine
    seen_w, seen_v, seen_b = np.full(n, 1e-2), np.full((n, DIMENSIONS), 1e-2), 1e-2
    lens = np.array([len(r[0]) for r in rows])
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), STEP):
            at = order[a : a + STEP]
            f = Features(0, len(at), np.repeat(np.arange(len(at)), lens[at]), np.concatenate([rows[i][0] for i in at]), np.concatenate([rows[i][1] for i in at]), statistics[at])
            doc, feature, value = machine.terms(f)
            margin, sums = machine.margin(doc, feature, value, len(at))
            error = (labels[at] - 1 / (1 + np.exp(-margin))) / len(at)
            g = error[doc] * value
            used, back = np.unique(feature, return_inverse=True)
            gw = np.bincount(back, weights=g) - DECAY * machine.weight[used]
            gv = np.stack([np.bincount(back, weights=g * (sums[doc, d] - machine.factor[feature, d] * value)) for d in range(DIMENSIONS)], axis=1) - DECAY * machine.factor[used]
            seen_w[used] += gw * gw
            seen_v[used] += gv * gv
            seen_b += error.sum() ** 2
            machine.weight[used] += RATE * gw / np.sqrt(seen_w[used])
            machine.factor[used] += RATE * gv / np.sqrt(seen_v[used])
            machine.bias += RATE * error.sum() / np.sqrt(seen_b)
    return machine


def _chars(b: pa.RecordBatch) -> np.ndarray:
    return np.nan_to_num(b.column("n_chars").to_numpy(zero_copy_only=False).astype(np.float64))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of labelled rows, packed: buckets in two bytes, values in four."""
    for b in batches:
        labels = b.column("label").to_pylist()
        for f in features(b.column("text"), _chars(b)):
            ends = np.searchsorted(f.doc, np.arange(f.stop - f.first + 1))
            parts = [(f.bucket[x:y].astype("<u2").tobytes(), f.value[x:y].astype("<f4").tobytes()) for x, y in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in parts], pa.binary()), pa.array([p[1] for p in parts], pa.binary()), pa.array([x.tobytes() for x in f.statistics.astype("<f8")], pa.binary()), pa.array(labels[f.first : f.stop], pa.int32())],
                ["buckets", "amounts", "statistics", "label"],
            )


def _scores(machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Machine = machine.value
        for b in batches:
            out = [np.zeros(0)]
            for f in features(b.column("text"), _chars(b)):
                margin, _ = m.margin(*m.terms(f), f.stop - f.first)
                out.append(1 / (1 + np.exp(-np.clip(margin, -40, 40))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(out))], [*b.schema.names, "score"])

    return run


def learn(documents: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, sample_rows: int = SAMPLE_ROWS) -> Machine:
    """Fit on at most `sample_rows` labelled rows: those with the smallest hashes among the rows
    whose crc32(doc_id as text) mod `folds` is not 0. Only their features reach the driver: at most
    six bytes for each of BUCKETS buckets a row."""
    fold = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % folds
    sample = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold != 0)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    sample = sample.groupBy("doc_id").agg(F.max("label").alias("label")).withColumn("draw", F.xxhash64("doc_id", F.lit(SEED)))
    many = sample.count()
    if many > sample_rows:  # hashes below a bound, a few more than needed, so tasks send on few rows
        share = min(1.0, (sample_rows + 6 * sample_rows**0.5) / many)
        sample = sample.where(F.col("draw") <= min(2**63 - 1, int(-(2**63) + 2**64 * share)))
    sample = sample.orderBy("draw", "doc_id").limit(sample_rows).drop("draw")
    chosen = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.col("n_chars").cast("double").alias("n_chars")).join(F.broadcast(sample), "doc_id")
    found = chosen.select("text", "n_chars", "label").mapInArrow(tidied(_rows), "buckets binary, amounts binary, statistics binary, label int").toArrow()
    lists = zip(*(found.column(c).to_pylist() for c in ("buckets", "amounts", "statistics")), strict=True)
    rows = [(np.frombuffer(b, "<u2").astype(np.int64), np.frombuffer(v, "<f4").astype(np.float64), np.frombuffer(s, "<f8")) for b, v, s in lists]
    order = sorted(range(len(rows)), key=lambda i: (len(rows[i][0]), rows[i][1].sum() if len(rows[i][1]) else 0.0, rows[i][2].sum()))  # whatever order tasks end in
    machine = fit([rows[i] for i in order], np.array(found.column("label").to_pylist(), dtype=np.float64)[order] if rows else np.zeros(0))
    del found, lists, rows
    release()  # the driver goes on
    return machine


def score_quality(documents: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, threshold: float = 0.3, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """All columns of `documents`, and held_out, score, predicted for every row.

    Learns `label` (0/1) from `labels` (doc_id, label) by `learn`; only text and n_chars are inputs
    of a score (labels, lang, source and doc_id never are). held_out: crc32(doc_id as text) mod
    `folds` is 0 (a null doc_id: false). score is in 0..1; null, empty and blank texts are scored
    by their statistics. predicted: 1 if score >= threshold. Without labels, or with one class
    only, every row has that class's rate. Columns named held_out, score or predicted are
    replaced, all others kept. Repeated rows give a row each; nothing is shuffled but the labels.
    """
    documents = documents.drop("held_out", "score", "predicted")
    machine = documents.sparkSession.sparkContext.broadcast(learn(documents, labels, label, folds, sample_rows))
    given = documents.columns
    cast = documents.withColumn("n_chars", F.col("n_chars").cast("double"))
    out = cast.mapInArrow(tidied(_scores(machine)), T.StructType([*cast.schema.fields, T.StructField("score", T.DoubleType())]))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % folds == 0, F.lit(False))
    out = out.withColumn("n_chars", F.col("n_chars").cast(documents.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in given], held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
