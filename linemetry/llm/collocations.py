"""Phrase collocations by hashed pruning (PCY, DHP).

Pass k counts the phrases of k words exactly, but only those that may be frequent: both their
parts of k - 1 words are in the bitmap of frequent ones (Apriori), and their bucket, counted in
the pass before, has enough occurrences. In the same pass every phrase of k + 1 words whose two
parts passed counts into its bucket. Bitmaps have a fixed size and are broadcast; they let too
many through, never too few, and what passes is counted by its text, so counts are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._memory import tidied
from ._runs import kinds, runs
from ._tables import discard, stored
from ._words import mix

#: Buckets of a pass, by their exponent (a bitmap has 2**BUCKET_BITS / 8 bytes), and those of a chunk that is added up by itself.
BUCKET_BITS, CHUNK_BITS = 24, 13
#: Bytes of text that are split at once; counted phrases that a task holds before it sends them on.
SLICE_BYTES, HELD = 4 << 20, 1 << 19
_KIND = kinds(b" \t", b".,;:!?\n\v\f\r")
_PLAIN = kinds(b" ")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE = mix(np.arange(256, dtype=np.uint64), 77) | np.uint64(1)
SCHEMA = "lang string, phrase string, amount long, chunk int, counts binary"


def _hashes(words: pa.LargeStringArray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + len(words) + 1]
    if not len(words):
        return np.zeros(0, np.uint64)
    data = np.frombuffer(words.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    return mix(np.add.reduceat(mix(_BYTE[data] + place.astype(np.uint64) * _BASE), offsets[:-1]), 5)


class Buckets:
    """Counts of buckets, each up to `most`, which is all that the threshold needs."""

    def __init__(self, bits: int, most: int) -> None:
        self.most = most
        self.counts = np.zeros(1 << bits, dtype=np.uint8 if most < 256 else np.uint32)

    def add(self, buckets: np.ndarray) -> None:
        at, times = np.unique(buckets, return_counts=True)
        self.counts[at] = np.minimum(self.counts[at].astype(np.int64) + times, self.most)

    def batches(self, chunk_bits: int) -> Iterator[pa.RecordBatch]:
        """Chunks that aren't all zero, as rows of SCHEMA."""
        rows = self.counts.reshape(-1, min(len(self.counts), 1 << chunk_bits))
        some = np.flatnonzero(rows.any(axis=1))
        for a in range(0, len(some), 256):
            at = some[a : a + 256]
            none = pa.nulls(len(at), pa.string())
            yield pa.RecordBatch.from_arrays([none, none, pa.nulls(len(at), pa.int64()), pa.array(at.astype(np.int32)), pa.array([rows[i].tobytes() for i in at], pa.binary())], ["lang", "phrase", "amount", "chunk", "counts"])


def _bucket(h: np.ndarray, k: int, bits: int) -> np.ndarray:
    return (mix(h, k) >> np.uint64(64 - bits)).astype(np.int64)


def _set(bitmap: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    return (bitmap[bucket >> 3] << (bucket & 7).astype(np.uint8)) & 0x80 != 0


class Held:
    """Phrases counted by a task, added up by their text when there are many."""

    def __init__(self) -> None:
        self.parts: list[pa.Table] = []
        self.rows = 0

    def add(self, lang: pa.Array, phrase: pa.Array, amount: np.ndarray) -> None:
        self.parts.append(pa.table([lang.cast(pa.string()), phrase.cast(pa.string()), pa.array(amount, pa.int64())], ["lang", "phrase", "amount"]))
        self.rows += len(amount)

    def batches(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            whole = pa.concat_tables(self.parts)
            if len(self.parts) > 1:
                whole = whole.group_by(["lang", "phrase"], use_threads=False).aggregate([("amount", "sum")]).rename_columns(["lang", "phrase", "amount"])
            for b in whole.combine_chunks().to_batches(1 << 16):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.nulls(len(b), pa.int32()), pa.nulls(len(b), pa.binary())], ["lang", "phrase", "amount", "chunk", "counts"])
        self.parts, self.rows = [], 0


def _pass(k: int, most_words: int, least: int, bits: int, parts, buckets):
    """Phrases of k words and their counts, and buckets of those of k + 1 words. parts, buckets: bitmaps
    of frequent phrases of k - 1 words, and of buckets of k words (k above 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ahead = Held(), Buckets(bits, least) if k < most_words else None
        apriori, hashed = (parts.value, buckets.value) if k > 1 else (None, None)
        for b in batches:
            langs = pc.fill_null(b.column("lang"), "und").cast(pa.large_string()).dictionary_encode()
            names, of = langs.dictionary, langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            starts = _hashes(names)
            for r in runs(b.column("text"), _KIND, SLICE_BYTES):
                coded = r.words.dictionary_encode()
                words, w = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                own, lang = _hashes(words), of[r.first : r.stop][r.doc]
                n = len(w)
                h = [starts[lang]]  # h[j][i]: of the language and the j words from place i on
                for j in range(k + 1 if ahead else k):
                    before = h[-1][: max(0, n - j)]
                    h.append(mix(before * _BASE + own[w[j : j + len(before)]]))
                if k == 1:
                    key, times = np.unique(lang * max(1, len(words)) + w, return_counts=True)
                    held.add(names.take(pa.array(key // max(1, len(words)))), words.take(pa.array(key % max(1, len(words)))), times)
                    total = np.bincount(lang, minlength=len(names))
                    some = np.flatnonzero(total)
                    held.add(names.take(pa.array(some)), pa.nulls(len(some), pa.string()), total[some])
                    passed = np.ones(n, dtype=bool)
                else:
                    m = max(0, n - k + 1)
                    frequent = _set(apriori, _bucket(h[k - 1], k - 1, bits))
                    passed = (r.piece[:m] == r.piece[k - 1 :][:m]) & frequent[:m] & frequent[1 : m + 1]
                    at = np.flatnonzero(passed)
                    good = _set(hashed, _bucket(h[k][at], k, bits))
                    passed[at[~good]] = False
                    at = at[good]
                    # equal phrases get equal numbers, word by word
                    number = lang[at]
                    for j in range(k):
                        _, number = np.unique(number * max(1, len(words)) + w[at + j], return_inverse=True)
                    _, first, times = np.unique(number, return_index=True, return_counts=True)
                    first = at[first]
                    text = pc.binary_join_element_wise(*[words.take(pa.array(w[first + j])) for j in range(k)], pa.scalar(" ", pa.large_string()))
                    held.add(names.take(pa.array(lang[first])), text, times)
                if ahead:
                    m = max(0, n - k)
                    at = np.flatnonzero(passed[:m] & passed[1 : m + 1] & (r.piece[:m] == r.piece[k:][:m]))
                    ahead.add(_bucket(h[k + 1][at], k + 1, bits))
                if held.rows >= HELD:
                    yield from held.batches()
        yield from held.batches()
        if ahead:
            yield from ahead.batches(CHUNK_BITS)

    return run


def _marks(k: int, bits: int, least: int):
    """Buckets of the phrases of k words in a table of frequent ones, as rows of SCHEMA."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets(bits, least)
        for b in batches:
            for r in runs(b.column("phrase"), _PLAIN, SLICE_BYTES):
                h, own = _hashes(b.column("lang").slice(r.first, r.size).cast(pa.large_string())), _hashes(r.words).reshape(-1, k)
                for j in range(k):
                    h = mix(h * _BASE + own[:, j])
                buckets.add(np.repeat(_bucket(h, k, bits), least))
        yield from buckets.batches(CHUNK_BITS)

    return run


def _merged(least: int):
    """Bits (chunk, bits) of the chunks whose rows a task gets: streamed, one array for each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.uint8 if least < 256 else np.uint32
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, counts in zip(b.column("chunk").to_pylist(), b.column("counts"), strict=True):
                one = np.frombuffer(counts.as_buffer(), dtype=kind)
                total[chunk] = np.minimum(total[chunk].astype(np.uint64) + one, least).astype(kind) if chunk in total else one.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([np.packbits(c >= least).tobytes() for c in total.values()], pa.binary())], ["chunk", "bits"])

    return run


def _bitmap(chunks: DataFrame, bits: int, least: int):
    """The broadcast bitmap of chunks (chunk, counts): 2**bits / 8 bytes, whatever the data."""
    rows = chunks.where("chunk is not null").select("chunk", "counts").repartition("chunk").mapInArrow(tidied(_merged(least)), "chunk int, bits binary").collect()
    out, size = np.zeros(max(1, (1 << bits) >> 3), dtype=np.uint8), max(1, (1 << min(bits, CHUNK_BITS)) >> 3)
    for r in rows:
        out[r.chunk * size : (r.chunk + 1) * size] = np.frombuffer(bytes(r.bits), dtype=np.uint8)
    return chunks.sparkSession.sparkContext.broadcast(out)


def _whole(c: str | Column) -> Column:
    """Wide enough for products of counts."""
    return F.col(c).cast("decimal(19,0)") if isinstance(c, str) else c.cast("decimal(19,0)")


def collocations(documents: DataFrame, most_words: int = 4, least: int = 30, top: int = 2000, covered: int = 80, bits: int = BUCKET_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each lang's `top` phrases of 2 to `most_words` words.

    Texts of `documents` (text, lang; null: empty, `und`) are lower-cased (A-Z), cut into pieces at
    . , ; : ! ? and line breaks, and those into words at spaces and tabs. n counts a lang's words, a
    a phrase's occurrences in pieces. Candidates have a >= `least`. Of their cuts into two parts
    with l and r occurrences the one of the lowest score floor(2000000 a / (l + r)) counts, of
    equal ones that with the shortest first part. Candidates inside a longer one with at least
    `covered` percent of their occurrences go. Ranks are by score and a, descending, then by the
    phrase's bytes.

    Counts cover all texts and are exact, whatever the number of buckets (2**bits): those bound the
    memory of a task and the broadcast, and tell how much is pruned. Repeated rows count each;
    other columns are ignored; without phrases the result is empty. Sums are made before any
    shuffle, so frequent phrases and langs don't meet in one task. Each pass is written to a table.
    """
    docs = documents.select("text", F.col("lang").cast("string").alias("lang"))
    context = docs.sparkSession.sparkContext
    frequent: list[DataFrame] = []
    totals = parts = buckets = None
    for k in range(1, most_words + 1):
        raw = stored(docs.mapInArrow(tidied(_pass(k, most_words, least, bits, parts, buckets)), SCHEMA), f"phrases-{k}")
        counted = raw.where("phrase is not null").groupBy("lang", "phrase").agg(F.sum("amount").alias("f")).where(F.col("f") >= least)
        frequent.append(stored(counted, f"frequent-{k}"))
        if k == 1:
            totals = stored(raw.where("phrase is null and chunk is null").groupBy("lang").agg(F.sum("amount").alias("n")), "words")
        if k < most_words:
            for old in (parts, buckets):
                if old is not None:
                    old.unpersist()
            parts = _bitmap(frequent[-1].mapInArrow(tidied(_marks(k, bits, least)), SCHEMA), bits, least)
            buckets = _bitmap(raw, bits, least)
        discard(raw)
    return _ranked(frequent, totals, top, covered)


def _ranked(frequent: list[DataFrame], totals: DataFrame, top: int, covered: int) -> DataFrame:
    def union(tables: list[DataFrame]) -> DataFrame:
        out = tables[0]
        for t in tables[1:]:
            out = out.unionByName(t)
        return out

    known = union(frequent[:-1])
    candidates = union(frequent[1:]).withColumn("words", F.split("phrase", " "))
    join = lambda start, length: F.array_join(F.slice("words", start, length), " ")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cuts = cuts.select("lang", "phrase", "f", "k", join(F.lit(1), F.col("k")).alias("head"), join(F.col("k") + 1, F.size("words") - F.col("k")).alias("tail"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(known.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    exact = F.expr("(cast(2000000 as decimal(7,0)) * cast(f as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    lowest = cuts.groupBy("lang", "phrase", "f").agg(F.min(F.struct(exact.alias("score"), "k", "l", "r")).alias("cut"))
    # of each phrase, the most frequent longer one that it lies in
    longer = candidates.withColumn("size", F.explode(F.sequence(F.lit(2), F.size("words") - 1))) if len(frequent) > 2 else candidates.where("false").withColumn("size", F.lit(2))
    longer = longer.where(F.size("words") > 2).withColumn("at", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("size") + 1)))
    longer = longer.select("lang", join(F.col("at"), F.col("size")).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("over"))
    kept = lowest.join(longer, ["lang", "phrase"], "left").where(F.col("over").isNull() | (_whole("over") * 100 < _whole("f") * covered))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    found = kept.select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")
    best = found.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
