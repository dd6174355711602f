"""Language identification by rank-order profiles (Cavnar and Trenkle 1994).

A language's profile is the list of its most frequent n-grams of letters, by rank. A document is
ranked in the same way, and its out-of-place distance to a profile is the sum, over its n-grams, of
how far their ranks lie apart; one that the profile lacks is as far away as the profile is long.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._memory import tidied

#: N-grams of a profile, and of a document, that are compared.
LENGTH = 400
#: Languages at most: all codes in use are fewer, so the broadcast profiles stay below 80 MB.
LANGUAGES = 16384
#: Characters that are counted at once; a longer text is counted in parts, cut between words.
PART = 1 << 20
#: Counted n-grams that a task holds before it sends them on; cells of distances that are filled at once.
HELD, CELLS = 1 << 19, 1 << 22
UNKNOWN = "und"
_kind = np.full(0x110000, -1, dtype=np.int8)  # of a code point: 0 other, 1 letter, 2 mark
Counts = tuple[np.ndarray, np.ndarray, np.ndarray]


def _kinds(codes: np.ndarray) -> np.ndarray:
    found = _kind[codes]
    new = np.unique(codes[found < 0])
    for c in new.tolist():
        _kind[c] = {"L": 1, "M": 2}.get(unicodedata.category(chr(c))[0], 0)
    return _kind[codes] if len(new) else found


def grams(texts: list[str]) -> tuple[Counts, np.ndarray]:
    """(text's number, n-gram, count), sorted, of all 1- to 3-grams of lower-cased words; and which texts
    have a letter. Words are runs of letters and marks; a border of one is a symbol too, but never
    alone and never in the middle. An n-gram is the number of its symbols in 21 bits each."""
    padded = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(padded).encode("utf-32-le"), dtype="<u4")
    text = np.repeat(np.arange(len(padded)), [len(p) for p in padded])
    kind = _kinds(codes)
    letter = kind > 0
    has = np.bincount(text[kind == 1], minlength=len(texts)) > 0
    kept = letter.copy()
    kept[1:] |= letter[:-1] | (text[1:] != text[:-1])
    kept[:1] = True
    symbol, text = np.where(letter, codes + 2, 1)[kept].astype(np.int64), text[kept]
    alphabet = np.unique(symbol)
    number = np.zeros(int(alphabet[-1]) + 1, dtype=np.int64)
    number[alphabet] = np.arange(1, len(alphabet) + 1)
    base = len(alphabet) + 1
    if len(texts) * base**3 >= 2**63:  # very many texts of very many letters
        half = len(texts) // 2
        (a, b), (x, y) = grams(texts[:half]), grams(texts[half:])
        return (np.concatenate([a[0], x[0] + half]), np.concatenate([a[1], x[1]]), np.concatenate([a[2], x[2]])), np.concatenate([b, y])
    s, of = number[symbol], text * base**3
    inner = symbol > 1
    two = np.flatnonzero(text[1:] == text[:-1])
    three = np.flatnonzero((text[2:] == text[:-2]) & inner[1:-1])
    keys = np.concatenate([(of + s)[inner], of[two] + s[two] * base + s[two + 1], of[three] + (s[three] * base + s[three + 1]) * base + s[three + 2]])
    keys, count = np.unique(keys, return_counts=True)
    text, rest = keys // base**3, keys % base**3
    names = np.concatenate([[0], alphabet])
    gram = names[rest // base**2] << 42 | names[rest // base % base] << 21 | names[rest % base]
    return (text, gram, count), has


def parts(text: str) -> Iterator[str]:
    """A text in parts of at most PART characters, cut after the last one that isn't a letter or mark, if any: no
    n-gram is lost."""
    at = 0
    while len(text) - at > PART:
        end = at + PART
        cut = next((i for i in range(end, max(at, end - 10000), -1) if unicodedata.category(text[i - 1])[0] not in "LM"), end)
        yield text[at:cut]
        at = cut
    yield text[at:]


def counted(texts: list[str]) -> Iterator[tuple[int, int, Counts, np.ndarray]]:
    """(first, stop, counts, has a letter) of slices of the texts; numbers count from first."""
    first = 0
    while first < len(texts):
        stop, size = first, 0
        while stop < len(texts) and (stop == first or size + len(texts[stop]) <= PART) and stop - first < PART // 8:
            size += len(texts[stop])
            stop += 1
        if size <= PART:
            yield first, stop, *grams(texts[first:stop])
        else:  # one long text
            gram, count, has = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, bool)
            for part in parts(texts[first]):
                (_, g, c), own = grams([part])
                gram, at = np.unique(np.concatenate([gram, g]), return_inverse=True)
                count = np.bincount(at, weights=np.concatenate([count, c])).astype(np.int64)
                has |= own
            yield first, stop, (np.zeros(len(gram), np.int64), gram, count), has
        first = stop


def ranks(counts: Counts, length: int) -> Counts:
    """(text, n-gram, rank) of each text's `length` most frequent n-grams; equal ones by their symbols."""
    text, gram, count = counts
    order = np.lexsort((gram, -count, text))
    text, gram = text[order], gram[order]
    rank = np.arange(len(text)) - np.searchsorted(text, text)
    kept = rank < length
    return text[kept], gram[kept], rank[kept]


@dataclass
class Profiles:
    """Ranks of n-grams in the languages: those of grams[i] at starts[i]..starts[i + 1]."""

    names: list[str]
    grams: np.ndarray
    starts: np.ndarray
    language: np.ndarray
    rank: np.ndarray
    length: int

    @staticmethod
    def of(rows: list[tuple[str, int, int]], length: int) -> Profiles:
        names = sorted({r[0] for r in rows})
        number = {n: i for i, n in enumerate(names)}
        lang, gram, rank = (np.array(x, dtype=np.int64) for x in ([number[r[0]] for r in rows], [r[1] for r in rows], [r[2] for r in rows]))
        order = np.lexsort((lang, gram))
        distinct, starts = np.unique(gram[order], return_index=True)
        return Profiles(names, distinct, np.append(starts, len(rows)), lang[order], rank[order], length)

    def nearness(self, ranked: Counts, texts: int) -> np.ndarray:
        """Of each text to each language: its n-grams times the length of a profile, less the out-of-place distance."""
        text, gram, rank = ranked
        if not len(self.grams):
            return np.zeros((texts, 0))
        at = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        hit = np.flatnonzero(self.grams[at] == gram)
        at = at[hit]
        many = self.starts[at + 1] - self.starts[at]
        row = np.repeat(hit, many)
        entry = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.starts[at], many)
        near = self.length - np.abs(rank[row] - self.rank[entry])
        return np.bincount(text[row] * len(self.names) + self.language[entry], weights=near, minlength=texts * len(self.names)).reshape(texts, -1)

    def nearest(self, counts: Counts, has: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Each text's language (of equal distances the first name) and score."""
        text, gram, rank = ranks(counts, self.length)
        names, scores, step = [], [], max(1, CELLS // max(1, len(self.names)))
        for a in range(0, len(has), step):
            b = min(len(has), a + step)
            x, y = np.searchsorted(text, [a, b])
            near = self.nearness((text[x:y] - a, gram[x:y], rank[x:y]), b - a)
            whole = np.bincount(text[x:y] - a, minlength=b - a) * float(self.length)
            if not near.shape[1]:
                names += [UNKNOWN] * (b - a)
                scores.append(np.zeros(b - a))
                continue
            best = near.argmax(axis=1)
            first = whole - near[np.arange(b - a), best]
            if near.shape[1] > 1:
                second = whole - np.partition(near, -2, axis=1)[:, -2]
            else:
                second = whole
            score = np.where(second > 0, (second - first) / np.maximum(second, 1), 0.0)
            names += [self.names[i] if h else UNKNOWN for i, h in zip(best, has[a:b], strict=True)]
            scores.append(np.where(has[a:b], score, 0.0))
        return names, np.concatenate([np.zeros(0), *scores])


def _language_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts (lang, gram, amount) of a task."""
    held, rows = [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            whole = pa.concat_tables(held).group_by(["lang", "gram"], use_threads=False).aggregate([("amount", "sum")]).rename_columns(["lang", "gram", "amount"])
            yield from whole.combine_chunks().to_batches(1 << 16)

    for b in batches:
        coded = b.column("lang").dictionary_encode()
        lang = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        for first, stop, (text, gram, count), _ in counted(b.column("text").to_pylist()):
            order = np.lexsort((gram, own := lang[first:stop][text]))
            own, gram, count = own[order], gram[order], count[order]
            heads = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (gram[1:] != gram[:-1])])) if len(own) else np.zeros(0, np.int64)
            if len(heads):
                held.append(pa.table([coded.dictionary.take(pa.array(own[heads])), pa.array(gram[heads]), pa.array(np.add.reduceat(count, heads))], ["lang", "gram", "amount"]))
                rows += len(heads)
            if rows >= HELD:
                yield from flush()
                held, rows = [], 0
    yield from flush()


def _predicted(profiles):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Profiles = profiles.value
        for b in batches:
            names, scores = [], [np.zeros(0)]
            for _, _, counts, has in counted([t or "" for t in b.column("text").to_pylist()]):
                found, score = p.nearest(counts, has)
                names += found
                scores.append(score)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(np.concatenate(scores))], [*b.schema.names, "lang_pred", "score"])

    return run


def learn(documents: DataFrame, length: int = LENGTH) -> Profiles:
    """Profiles of the languages of `documents` (text, lang): the `length` most frequent n-grams of all
    their texts. Rows without text or lang teach nothing. Counts are added up in tasks before they
    are shuffled, and only the profiles reach the driver."""
    rows = documents.where("text is not null and lang is not null").select("text", F.col("lang").cast("string").alias("lang"))
    counts = rows.mapInArrow(tidied(_language_counts), "lang string, gram long, amount long").groupBy("lang", "gram").agg(F.sum("amount").alias("amount"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("amount"), "gram")) - 1
    best = counts.withColumn("rank", rank).where(F.col("rank") < length).select("lang", "gram", "rank").limit(LANGUAGES * length + 1).collect()
    if len(best) > LANGUAGES * length:
        raise ValueError(f"lang has more than {LANGUAGES} values: these aren't languages")
    return Profiles.of([tuple(r) for r in best], length)


def identify_languages(documents: DataFrame, folds: int = 5, length: int = LENGTH) -> DataFrame:
    """All columns of `documents` (doc_id, text, lang, ..), and held_out, lang_pred, score for every row.

    Learns from the texts and non-null langs of rows whose crc32(doc_id as text) mod `folds` is not
    0 (held_out: it is 0; a null doc_id teaches nothing and isn't held out); only the text is an input of a
    prediction. lang_pred: the language whose profile is nearest by out-of-place distance, of equal
    ones the first by name; `und` where the text is null or has no letter, or nothing was learned.
    score: the second distance less the first, over the second (with one language the largest
    possible distance is the second), so 0 where two are as near; 0 with `und`.

    Whole texts are counted, long ones in parts. Columns named held_out, lang_pred or score are
    replaced, all others kept. Repeated rows give a row each; an empty table an empty result. No
    text is shuffled.
    """
    documents = documents.drop("held_out", "lang_pred", "score")
    fold = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % folds
    profiles = documents.sparkSession.sparkContext.broadcast(learn(documents.where(fold != 0), length))
    given = [f"`{c}`" for c in documents.columns]
    schema = T.StructType([*documents.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    out = documents.mapInArrow(tidied(_predicted(profiles)), schema)
    return out.select(*given, F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
