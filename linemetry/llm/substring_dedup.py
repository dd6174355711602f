"""Substring dedup by prefix-partitioned suffix trees over words.

A suffix of a document's words goes to a group by its prefix. Prefixes have variable length: a
prefix that holds more suffixes than a group should is extended by a word, as often as needed
(up to `words` words), so groups fit in memory. A group builds the part of the generalised suffix
tree below its prefixes as deep as it matters, as a suffix array: its suffixes in the order of
their keys, with the depth at which neighbours part. A key has codes of the suffix's beginnings
at LEVELS depths, then the hash of its first `words` words, so neighbours share as many words as
the codes say. Runs whose neighbours part no sooner than `words` are the internal nodes of at
least that depth. A node's occurrences outside the smallest document under it repeat; runs of
such windows are a document's maximal repeats.

Before suffixes are dealt, equal windows of one flush are reduced to those of their smallest
document; the others are known to repeat already. So a passage that very many documents share
reaches its group once for each flush. Beyond GROUPS groups the suffixes go there in two hops:
first to GROUPS parts, where they are reduced again and dealt on by their whole window.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words
from ._memory import tidied
from ._tables import stored

#: Suffixes that are reduced together before they are dealt.
FLUSH = 1 << 19
#: Suffixes of a group on average, and groups that one hop deals to.
GROUP_SUFFIXES, GROUPS = 1 << 20, 4096
#: Codes of a key, of four bits each.
LEVELS = 8
_DEALT = "part int, kind int, docs binary, counts binary, windows binary, places binary"
_KINDS = (pa.int32(), pa.int32(), *[pa.binary()] * 4)


def levels(words: int) -> list[int]:
    """The depths at which a key has codes: LEVELS at most, between 1 and `words` - 1."""
    return sorted({d for i in range(1, LEVELS + 1) if 0 < (d := round(words * i / (LEVELS + 1))) < words})


def keys(w: _words.Words, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the suffixes of at least `words` words: window hash, codes, number of the first word."""
    m = len(w.hash) - words + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64)
    at = np.flatnonzero(w.doc[:m] == w.doc[words - 1 :])
    h, code, depths = np.zeros(m, dtype=np.uint64), np.zeros(m, dtype=np.uint32), set(levels(words))
    for j in range(words):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w.hash[j : m + j]
        if j + 1 in depths:
            code = code << np.uint32(4) | (h >> np.uint64(60)).astype(np.uint32)
    return _words.mix(h[at], words), code[at], at


def suffix_order(h: np.ndarray, code: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order of their keys, and how many words each shares with the one before it
    (0 for the first; below `words`, the greatest level whose codes agree)."""
    order = np.lexsort((h, code))
    depth = np.zeros(len(order), dtype=np.int64)
    if len(order) > 1:
        depths = levels(words)
        apart = code[order][1:] ^ code[order][:-1]
        agree = sum(((apart >> np.uint32(4 * i)) == 0).astype(np.int64) for i in range(len(depths)))
        depth[1:] = np.array([0, *depths])[agree]
        depth[1:][(apart == 0) & (h[order][1:] == h[order][:-1])] = words
    return order, depth


def _prefixes(hashes: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Hash of the first `depth` words of the suffixes that start at words `at`."""
    h = np.zeros(len(at), dtype=np.uint64)
    for j in range(depth):
        h = h * np.uint64(0x9E3779B97F4A7C15) + hashes[at + j]
    return _words.mix(h, 50 + depth)


def _known(doc: np.ndarray, h: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Which windows a smaller document of the same flush has too. Windows are the same if all bits of their
    hashes and codes are; where equal hashes with other codes stand between, it is left to the tree."""
    order = np.argsort(h, kind="stable")
    heads = np.flatnonzero(np.concatenate([[True], (np.diff(h[order]) != 0) | (np.diff(code[order]) != 0)]))
    least = np.minimum.reduceat(doc[order], heads)
    known = np.zeros(len(h), dtype=bool)
    known[order] = doc[order] > np.repeat(least, np.diff(np.concatenate([heads, [len(h)]])))
    return known


def _frequent_prefixes(words: int, share: float):
    """(depth, prefix, n) where a prefix has about `share` of a task's suffixes; depth 0: all. Only suffixes
    that are dealt to the tree count, so the copies of a passage count once a flush and make no rows of their own.
    What a flush and then the task leave out is below half the share each, so counts lack less than the share."""

    def summed(found: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        depth = np.concatenate([np.full(len(n), d, np.int32) for d, _, n in found])
        prefix, n = np.concatenate([p for _, p, _ in found]), np.concatenate([n for *_, n in found])
        order = np.lexsort((prefix, depth))
        depth, prefix = depth[order], prefix[order]
        heads = np.flatnonzero(np.concatenate([[True], (np.diff(depth) != 0) | (prefix[1:] != prefix[:-1])]))
        return depth[heads], prefix[heads], np.add.reduceat(n[order], heads)

    def rows(found: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        depth, prefix, n = summed(found)
        keep = n >= share / 2 * n[0]  # the first row is that of depth 0
        return pa.RecordBatch.from_arrays([pa.array(depth[keep]), pa.array(prefix[keep].view(np.int64)), pa.array(n[keep])], ["depth", "prefix", "n"])

    def flush(held: list[tuple[np.ndarray, ...]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        hashes, parts, *windows = zip(*held, strict=True)
        before = np.cumsum([0, *map(len, hashes)])[:-1]
        hashes, at = np.concatenate(hashes), np.concatenate([x + y for x, y in zip(parts, before, strict=True)])
        at = at[~_known(*[np.concatenate(x) for x in windows])]
        size = len(at)
        yield 0, np.zeros(1, np.uint64), np.array([size])
        for depth in range(1, words):
            prefix = _prefixes(hashes, at, depth)
            found, n = np.unique(prefix, return_counts=True)
            keep = n >= share / 2 * size
            if not keep.any():
                break
            yield depth, found[keep], n[keep]
            at = at[np.isin(prefix, found[keep])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, found = [], 0, []
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for w in _words.slices(b.column(1), lower=False):
                h, code, at = keys(w, words)
                if not len(at):
                    continue
                held.append((w.hash, at, ids[w.first + w.doc[at]], h, code))
                size += len(at)
                if size >= FLUSH:
                    found += flush(held)
                    held, size = [], 0
                    if sum(len(n) for *_, n in found) >= 2 * FLUSH:  # what follows is a task of its own
                        yield rows(found)
                        found = []
        if size:
            found += flush(held)
        if found:
            yield rows(found)

    return run


def pack_places(doc: np.ndarray, place: np.ndarray) -> bytes:
    """Places, ascending within a document, as byte planes of their differences."""
    step = np.diff(place.astype(np.int64), prepend=0)
    new = np.concatenate([[True], doc[1:] != doc[:-1]])
    step[new] = place[new]
    return np.ascontiguousarray(step.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unpack_places(data: bytes, counts: np.ndarray) -> np.ndarray:
    step = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
    total = np.cumsum(step)
    heads = np.cumsum(counts) - counts
    return total - np.repeat(total[heads] - step[heads], counts)


def pack_docs(doc: np.ndarray) -> bytes:
    """Ids, ascending, as byte planes of their differences: most bytes are zero, so a shuffle compresses them."""
    return np.ascontiguousarray(np.diff(doc.astype("<i8").view("<u8"), prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_docs(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel()).view(np.int64)


def _rows(kind: int, part: np.ndarray, doc: np.ndarray, place: np.ndarray, h: np.ndarray | None, code: np.ndarray | None) -> Iterator[tuple]:
    """Suffixes in order of document and place, packed by part."""
    order = np.argsort(part, kind="stable")
    part, doc, place = part[order], doc[order], place[order]
    if h is not None:
        wide = np.empty((len(order), 11), dtype=np.uint8)
        wide[:, :7] = h[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]
        wide[:, 7:] = code[order].astype("<u4").view(np.uint8).reshape(-1, 4)
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(part)]]), strict=True):
        if b > a:
            heads = np.concatenate([[0], np.flatnonzero(np.diff(doc[a:b])) + 1])
            n = np.diff(np.concatenate([heads, [b - a]])).astype(np.uint32)
            yield int(part[a]), kind, pack_docs(doc[a:b][heads]), n.tobytes(), wide[a:b].tobytes() if h is not None else b"", pack_places(doc[a:b], place[a:b])


def _unpacked(docs: bytes, counts: bytes, windows: bytes, places: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = np.frombuffer(counts, np.uint32)
    wide = np.frombuffer(windows, np.uint8).reshape(-1, 11)
    h = np.zeros((len(wide), 8), dtype=np.uint8)
    h[:, :7] = wide[:, :7]
    return np.repeat(unpack_docs(docs), n), unpack_places(places, n), h.view("<u8").ravel(), np.ascontiguousarray(wide[:, 7:]).view("<u4").ravel()


def _reduced(doc: np.ndarray, place: np.ndarray, h: np.ndarray, code: np.ndarray, part: np.ndarray, buckets: int) -> pa.RecordBatch:
    """kind 0: suffixes to be looked up in the tree; 1: windows that are known to repeat, since a
    smaller document of the same flush has them, dealt by their documents."""
    known = _known(doc, h, code)
    by = np.lexsort((place, doc))  # rows of a document may stand apart
    doc, place, h, code, part, known = doc[by], place[by], h[by], code[by], part[by], known[by]
    out = [*_rows(0, part[~known], doc[~known], place[~known], h[~known], code[~known])]
    if known.any():
        doc, place = doc[known], place[known]
        out += _rows(1, (_words.mix(doc.view(np.uint64)) % np.uint64(buckets)).astype(np.int32), doc, place, None, None)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), _KINDS, strict=True)], [x.split()[0] for x in _DEALT.split(", ")])


def _deal(words: int, groups: int, buckets: int, frequent: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for w in _words.slices(b.column(1), lower=False):
                h, code, at = keys(w, words)
                if not len(at):
                    continue
                key, open_ = _prefixes(w.hash, at, 1), np.arange(len(at))
                for depth, often in enumerate(frequent, 1):
                    open_ = open_[np.isin(key[open_], often)]
                    if not len(open_):
                        break
                    key[open_] = _prefixes(w.hash, at[open_], depth + 1)
                held.append((ids[w.first + w.doc[at]], (at - w.heads[w.doc[at]]).astype(np.uint32), h, code, (_words.mix(key) % np.uint64(groups)).astype(np.int32)))
                size += len(at)
                if size >= FLUSH:
                    arrays = [np.concatenate(x) for x in zip(*held, strict=True)]
                    held, size = [], 0
                    yield _reduced(*arrays, buckets)
        if size:
            yield _reduced(*[np.concatenate(x) for x in zip(*held, strict=True)], buckets)

    return run


def _deal_on(fine: int, buckets: int):
    """Of rows of _DEALT that stand together by part: each part's suffixes reduced and dealt to
    `fine` groups by their whole window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, of = [], 0, -1

        def flush() -> pa.RecordBatch:
            doc, place, h, code = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            return _reduced(doc, place.astype(np.uint32), h, code, (of * fine + (_words.mix(h, 3) % np.uint64(fine)).astype(np.int64)).astype(np.int32), buckets)

        for b in batches:
            kinds = b.column("kind").to_numpy()
            if (kinds == 1).any():
                yield b.filter(pa.array(kinds == 1))
            rows = b.filter(pa.array(kinds == 0))
            for part, *packed in zip(*(rows.column(c).to_pylist() for c in ("part", "docs", "counts", "windows", "places")), strict=True):
                if held and (part != of or size >= FLUSH):
                    yield flush()
                    size = 0
                of = part
                held.append(_unpacked(*packed))
                size += len(held[-1][0])
        if held:
            yield flush()

    return run


def _subtree(words: int, buckets: int):
    """Of one group: the windows that a smaller document has too, packed by bucket of documents."""

    def run(table: pa.Table) -> pa.Table:
        out_doc, out_place, held = [], [], []
        for kind, d, c, h, p in zip(*(table.column(x).to_pylist() for x in ("kind", "docs", "counts", "windows", "places")), strict=True):
            if kind:
                n = np.frombuffer(c, np.uint32)
                out_doc.append(np.repeat(unpack_docs(d), n))
                out_place.append(unpack_places(p, n))
            else:
                held.append(_unpacked(d, c, h, p))
        if held:
            doc, place, h, code = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order, depth = suffix_order(h, code, words)
            nodes = np.flatnonzero(depth < words)  # where each node of depth >= words, or lone leaf, begins
            least = np.minimum.reduceat(doc[order], nodes)
            repeats = order[doc[order] > np.repeat(least, np.diff(np.concatenate([nodes, [len(h)]])))]
            out_doc.append(doc[repeats])
            out_place.append(place[repeats])
        doc, place = np.concatenate(out_doc), np.concatenate(out_place)
        bucket = (_words.mix(doc.view(np.uint64), 7) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((place, doc, bucket))
        doc, place, bucket = doc[order], place[order], bucket[order]
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        out = [(int(bucket[x]), doc[x:y].tobytes(), place[x:y].astype("<u4").tobytes()) for x, y in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(doc)]]), strict=True) if y > x]
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], ["bucket", "docs", "places"])

    return run


def _gathered(table: pa.Table) -> pa.Table:
    """Of one bucket of documents: the places of each, from all groups."""
    doc = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table.column("docs")])
    place = np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in table.column("places")])
    order = np.lexsort((place, doc))
    doc, place = doc[order], place[order]
    heads = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    packed = [place[x:y].tobytes() for x, y in zip(heads, np.concatenate([heads[1:], [len(doc)]]), strict=True)]
    return pa.table([pa.array(doc[heads]), pa.array(packed, pa.binary())], ["doc_id", "places"])


def _cut(words: int, joined: bool):
    """Of rows (doc_id, text, places): counts, kept text and the spans that went."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, places = b.column(1), b.column(2).to_pylist()
            for w in _words.slices(texts, lower=False, hashed=False):
                kept, removed, spans = [], [], []
                whole = w.data.tobytes()
                for i in range(w.stop - w.first):
                    a, n = w.heads[i], w.counts[i]
                    gone = np.zeros(n + 1, dtype=np.int32)
                    p = np.frombuffer(places[w.first + i] or b"", "<u4").astype(np.int64)
                    p = p[p < n]
                    np.add.at(gone, p, 1)
                    np.add.at(gone, np.minimum(p + words, n), -1)
                    gone = np.cumsum(gone)[:n] > 0
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                    spans.append([{"start": int(x), "words": int(y - x)} for x, y in edge.reshape(-1, 2)])
                    removed.append(int(gone.sum()))
                    start, end = w.start[a : a + n], w.end[a : a + n]
                    if joined:
                        kept.append(b" ".join([whole[x:y] for x, y in zip(start[~gone].tolist(), end[~gone].tolist(), strict=True)]))
                    else:  # a span goes with the white space after it
                        cuts = [w.offsets[i]]
                        for x, y in edge.reshape(-1, 2):
                            cuts += [start[x], start[y] if y < n else w.offsets[i + 1]]
                        cuts.append(w.offsets[i + 1])
                        kept.append(b"".join(whole[x:y] for x, y in zip(cuts[::2], cuts[1::2], strict=True)))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(w.first, w.stop - w.first), pa.array(w.counts.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32())])))],
                    ["doc_id", "n_words", "n_removed", "kept", "spans"],
                )

    return run


def repeated_windows(documents: DataFrame, words: int = 13) -> DataFrame:
    """(doc_id, places): word numbers, packed as little-endian uint32, at which a window of `words`
    words starts that also starts in a document with a smaller doc_id; no row without any."""
    docs = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # n bytes hold (n + 1) / 2 words at most, so there are no more parts than `most`, and reported counts are
    # too small by at most a quarter of a part's share
    size = docs.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    most = min(GROUPS, max(16, math.ceil(size / 2 / GROUP_SUFFIXES)))
    counts = stored(docs.mapInArrow(tidied(_frequent_prefixes(words, 1 / (4 * most))), "depth int, prefix long, n long").groupBy("depth", "prefix").agg(F.sum("n").alias("n")), "substring-prefixes")
    whole = counts.where("depth = 0").first()
    total = whole.n if whole else 0
    groups = max(16, math.ceil(total / GROUP_SUFFIXES))
    parts = min(GROUPS, groups)
    fine = math.ceil(groups / parts)
    # of each depth at most 4/3 prefixes for each part reach the bound, so what is collected has a
    # proven size
    often = counts.where((F.col("depth") > 0) & (F.col("n") >= 3 * total / (4 * parts))).collect()
    frequent = [np.sort(np.array([r.prefix for r in often if r.depth == d], dtype=np.int64).view(np.uint64)) for d in range(1, words)]
    dealt = docs.mapInArrow(tidied(_deal(words, parts, parts * fine, frequent)), _DEALT)
    if fine > 1:
        dealt = dealt.repartition("part").sortWithinPartitions("part").mapInArrow(tidied(_deal_on(fine, parts * fine)), _DEALT)
    found = dealt.groupBy("part").applyInArrow(_subtree(words, parts * fine), "bucket int, docs binary, places binary")
    return found.groupBy("bucket").applyInArrow(_gathered, "doc_id long, places binary")


def substring_dedup(documents: DataFrame, words: int = 13, joined: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept, spans for every row of `documents` (doc_id, text).

    A word is removed if a window of `words` words covers it that also starts in a document with a
    smaller doc_id; windows are judged on the input. kept: the other words joined by one space, or
    with joined=False the text without the removed spans and the white space after each. spans:
    the maximal runs of removed words (start, words). Null, empty and blank texts have no words
    and keep an empty (joined=False: their own) text. Rows with a null doc_id lose nothing and
    take nothing from others. doc_id is the key: rows that repeat it never count as smaller.
    Other columns, whatever their names, are ignored. Windows are told apart by 88 bits
    of their keys.
    """
    places = stored(repeated_windows(documents, words), "substring-places")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(places, "doc_id", "left")
    return docs.mapInArrow(tidied(_cut(words, joined)), "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start:int,words:int>>")


def without_repeats(documents: DataFrame, words: int = 13) -> DataFrame:
    """`documents` with the spans of `substring_dedup` (joined=False) cut out of the texts, and
    n_chars (if there is such a column) of changed texts anew. Texts are shuffled once. Other rows
    and columns stay as they are, whatever their names; null and empty texts and rows with a null
    doc_id too. Rows that repeat a doc_id give a row each; an empty table gives an empty result."""
    places = stored(repeated_windows(documents, words), "substring-places")
    cut, fields = _cut(words, joined=False), documents.schema.fields
    names = [f.name for f in fields]
    at, sized = names.index("text"), names.index("n_chars") if "n_chars" in names else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = b.column(0).flatten()
            text = columns[at].to_pylist()
            part = pa.RecordBatch.from_arrays([columns[names.index("doc_id")], columns[at], b.column(1)], ["doc_id", "text", "places"])
            for out in cut(iter([part])) if b.num_rows else ():
                begin = b.num_rows - len(text)
                kept, gone = out.column("kept").to_pylist(), out.column("n_removed").to_pylist()
                now = [k if n else t for k, n, t in zip(kept, gone, text, strict=False)]
                text = text[len(kept) :]
                own = [c.slice(begin, len(kept)) for c in columns]
                own[at] = pa.array(now, columns[at].type)
                if sized >= 0:
                    own[sized] = pa.array([len(t) if n else old for t, n, old in zip(now, gone, own[sized].to_pylist(), strict=True)], columns[sized].type)
                yield pa.RecordBatch.from_arrays(own, names)

    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    joined = rows.join(places, F.col("row.doc_id").cast("long") == F.col("doc_id"), "left").select("row", "places")
    return joined.mapInArrow(tidied(run), documents.schema)
