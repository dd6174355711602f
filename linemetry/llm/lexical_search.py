"""Ranked lexical search by MaxScore, shard by shard.

A shard is a bounded run of documents within a task. It holds the posting lists of the queries'
terms: documents in order of doc_id, with what the term adds to their score, and the list's upper
bound. For each query the lists stand by their bounds. Those whose bounds together can't lift a
document over the k-th best score so far are non-essential: documents are found through the other
lists only, and non-essential ones are probed, the largest bound first, only for documents that
can still qualify. The best k of every shard are then ranked together.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._memory import tidied
from ._runs import kinds, runs

#: Bytes that stand between terms: all ASCII but letters and digits.
_KIND = kinds(bytes(b for b in range(128) if not chr(b).isalnum()))
#: Bytes of text that are split at once; documents and postings of a shard at most (a document isn't cut); documents
#: that are scored together.
SLICE_BYTES, SHARD_DOCS, SHARD_POSTINGS, BLOCK = 1 << 20, 16384, 1 << 21, 1024
#: Bytes of queries that are sent to every task at once, on average; more of them are searched block by block.
QUERY_BYTES = 4 << 20
#: The parts of the score's formula.
B, SATURATION, UNIT = 75, 8, 1000


@dataclass
class Queries:
    """Queries of a block: their distinct terms, and for each its terms with how often it has them."""

    ids: list[int | None]
    terms: pa.LargeStringArray
    asked: list[tuple[np.ndarray, np.ndarray]]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    docs: int = 0
    length: int = 0


def parsed(rows: list[tuple[int | None, str | None]]) -> Queries:
    found, numbers, asked = [], {}, []
    for _, text in rows:
        one = next(runs(pa.array([text], pa.string()), _KIND, SLICE_BYTES))
        own = Counter(numbers.setdefault(t, len(numbers)) for t in one.words.to_pylist())
        asked.append((np.array(list(own), dtype=np.int64), np.array(list(own.values()), dtype=np.int64)))
    found = pa.array(list(numbers), pa.large_string())
    return Queries([i for i, _ in rows], found, asked)


def _known(q: Queries, words: pa.LargeStringArray) -> np.ndarray:
    """The term of each word, -1 for words that no query has."""
    return pc.fill_null(pc.index_in(words, q.terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _statistics(queries):
    """Rows (term, amount) of a task: documents that hold the term; under -1 all documents with terms,
    under -2 all terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Queries = queries.value
        holding, docs, length = np.zeros(len(q.terms), np.int64), 0, 0
        for b in batches:
            for r in runs(b.column("text"), _KIND, SLICE_BYTES):
                docs += int((np.bincount(r.doc, minlength=r.size) > 0).sum())
                length += len(r.doc)
                term = _known(q, r.words)
                hit = term >= 0
                pairs = np.unique(r.doc[hit] * len(q.terms) + term[hit])
                if len(pairs):
                    holding += np.bincount(pairs % len(q.terms), minlength=len(q.terms))
        some = np.flatnonzero(holding)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1, -2], some])), pa.array(np.concatenate([[docs, length], holding[some]]))], ["term", "amount"])

    return run


class Shard:
    """Documents and postings that are gathered, then searched."""

    def __init__(self, q: Queries) -> None:
        self.q, self.ids, self.sizes, self.docs, self.terms, self.times, self.count, self.postings = q, [], [], [], [], [], 0, 0

    def add(self, ids: pa.Array, words: np.ndarray, doc: np.ndarray, size: int) -> None:
        hit = words >= 0
        width = max(1, len(self.q.terms))
        pairs, times = np.unique(doc[hit] * width + words[hit], return_counts=True)
        self.ids.append(ids)
        self.sizes.append(np.bincount(doc, minlength=size))
        self.docs.append(pairs // width + self.count)
        self.terms.append(pairs % width)
        self.times.append(times)
        self.count += size
        self.postings += len(pairs)

    def build(self) -> None:
        q = self.q
        ids = pa.chunked_array(self.ids).combine_chunks() if self.ids else pa.array([], pa.int64())
        null = pc.is_null(ids).to_numpy(zero_copy_only=False)
        plain = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
        order = np.lexsort((plain, null))  # by doc_id, null ones last
        place = np.empty(self.count, np.int64)
        place[order] = np.arange(self.count)
        self.id_of = ids.take(pa.array(order))
        sizes = np.concatenate([np.zeros(0, np.int64), *self.sizes])[order]
        if q.length and B * int(sizes.max(initial=0)) * q.docs >= 2**63:
            part = np.array([(B * int(n) * q.docs) // q.length for n in sizes], dtype=np.int64)
        else:
            part = B * sizes * q.docs // max(1, q.length)
        norm = UNIT // 10 - B + part
        doc, term, times = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (self.docs, self.terms, self.times))
        doc = place[doc]
        by = np.argsort(term * max(1, self.count) + doc)
        self.doc, term, times = doc[by], term[by], times[by]
        self.adds = q.weights[term] * (10**9 * times // (UNIT * times + SATURATION * norm[self.doc]))
        self.starts = np.arange(0, self.count + BLOCK, BLOCK)
        # where each term's list enters each block
        key = term * max(1, self.count) + self.doc
        edges = np.arange(len(q.terms))[:, None] * max(1, self.count) + np.minimum(self.starts, self.count)[None, :]
        self.edges = np.searchsorted(key, edges.ravel()).reshape(edges.shape)
        self.bound = np.zeros(len(q.terms), np.int64)
        there = np.flatnonzero(self.edges[:, -1] > self.edges[:, 0]) if self.count else np.zeros(0, np.int64)
        if len(there):
            self.bound[there] = np.maximum.reduceat(self.adds, self.edges[there, 0])

    def best(self, number: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Places and scores of a query's k best documents (equal scores: smaller places), and how many
        postings were read."""
        terms, often = self.q.asked[number]
        bounds = often * self.bound[terms]
        by = np.argsort(bounds, kind="stable")
        by = by[bounds[by] > 0]
        terms, often, reach = terms[by], often[by], np.cumsum(bounds[by])
        places, scores, least, read = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 0
        for b in range(len(self.starts) - 1):
            # later documents have larger places, so they must be above the k-th best, not equal
            essential = int(np.searchsorted(reach, least, side="right"))
            if essential == len(terms):
                break
            at, total = self.starts[b], np.zeros(BLOCK, np.int64)
            for i in range(essential, len(terms)):
                x, y = self.edges[terms[i], b], self.edges[terms[i], b + 1]
                total[self.doc[x:y] - at] += often[i] * self.adds[x:y]
                read += y - x
            found = np.flatnonzero(total)
            score = total[found]
            for i in range(essential - 1, -1, -1):
                can = score + reach[i] > least
                found, score = found[can], score[can]
                if not len(found):
                    break
                x, y = self.edges[terms[i], b], self.edges[terms[i], b + 1]
                if y > x:
                    own = self.doc[x:y] - at
                    near = np.minimum(np.searchsorted(own, found), y - x - 1)
                    score = score + np.where(own[near] == found, often[i] * self.adds[x + near], 0)
                    read += len(found)
            good = score > least
            if good.any():
                places, scores = np.concatenate([places, found[good] + at]), np.concatenate([scores, score[good]])
                top = np.lexsort((places, -scores))[:k]
                places, scores = places[top], scores[top]
                if len(top) == k:
                    least = int(scores[-1])
        return places, scores, read

    def answers(self, k: int) -> pa.RecordBatch:
        self.build()
        numbers, places, scores = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for number in range(len(self.q.ids)):
            p, s, _ = self.best(number, k)
            numbers += [number] * len(p)
            places.append(p)
            scores.append(s)
        items = pa.array([self.q.ids[n] for n in numbers], pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), items, self.id_of.take(pa.array(np.concatenate(places))), pa.array(np.concatenate(scores))], ["number", "item_id", "doc_id", "score"])


def _search(queries, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Queries = queries.value
        shard = Shard(q)
        for b in batches:
            for r in runs(b.column("text"), _KIND, SLICE_BYTES):
                shard.add(b.column("doc_id").slice(r.first, r.size), _known(q, r.words), r.doc, r.size)
                if shard.count >= SHARD_DOCS or shard.postings >= SHARD_POSTINGS:
                    yield shard.answers(k)
                    shard = Shard(q)
        if shard.count:
            yield shard.answers(k)

    return run


def _ranked(docs: DataFrame, rows: list[tuple[int | None, str | None]], k: int) -> DataFrame:
    context, q = docs.sparkSession.sparkContext, parsed(rows)
    counted = docs.select("text").mapInArrow(tidied(_statistics(context.broadcast(q))), "term long, amount long").groupBy("term").agg(F.sum("amount").alias("amount"))
    amounts = {r.term: r.amount for r in counted.collect()}  # one row for each term of the queries
    q.docs, q.length = amounts.get(-1, 0), amounts.get(-2, 0)
    q.weights = np.array([math.floor(UNIT * math.log((2 * q.docs + 2) / (2 * amounts.get(t, 0) + 1))) for t in range(len(q.terms))], dtype=np.int64)
    found = docs.mapInArrow(tidied(_search(context.broadcast(q), k)), "number int, item_id long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def lexical_search(documents: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: for every row of `items` (item_id, text) its k documents with the
    highest scores above 0, equal scores by ascending doc_id; all, if there are fewer.

    Terms are runs of letters, digits and all beyond ASCII, A-Z lower-cased, of whole texts. With N
    documents that have terms, L terms in all, df documents that hold a term, n terms of a
    document and tf of them the same: a term weighs w = floor(1000 ln((2N+2)/(2df+1))), a
    document's length counts as m = 25 + 75nN div L, and its score is the sum of w * (10^9 tf div
    (1000 tf + 8m)) over the item's terms, repeats included.

    Null and empty texts have no terms: such items have no rows, such documents aren't found. Every
    row of `documents` is a document of its own, also where a doc_id repeats, and a null doc_id
    stands after all others; every row of `items` is ranked for itself. Other columns are
    ignored. Without documents or items the result is empty. Documents are read twice (counts,
    search) and never shuffled; only the best k of each shard are. Queries are sent to the tasks in
    blocks of about QUERY_BYTES, each searched by itself, however many there are.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = asked.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, math.ceil(size / QUERY_BYTES))
    out = None
    for block in range(blocks):
        own = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        found = _ranked(docs, [(r.item_id, r.text) for r in own.collect()], k)
        out = found if out is None else out.unionByName(found)
    return out
