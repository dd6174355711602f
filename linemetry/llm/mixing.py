"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _words
from ._memory import tidied
from ._tables import stored

#: Blocks of the whole mix, and output shards that have a quota each. Both are fixed, so the
#: tables that the driver makes don't grow with the data; a block does.
BLOCKS, SHARDS = 8192, 64
#: Blocks for each source of a level, and the least that a source's target has in its level.
LEVEL_BLOCKS, LEAST_BLOCKS = 256, 64
#: Runs of a source's seeded order that are summed apart.
RUNS = 1024


def targets(sizes: dict[str | None, int], weights: tuple[int, ...], share: float, most: float) -> dict[str | None, float]:
    """Words of each source. Sources by code point, null last, have the weights in turn and share
    `share` times all words by weight; where that is above `most` times a source's words it stops
    there and the excess is shared anew."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, found = share * sum(sizes.values()), {}
    open_ = [s for s in order if sizes[s] > 0]
    found |= {s: 0.0 for s in order if sizes[s] <= 0}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not full:
            found |= {s: left * weight[s] / total for s in open_}
            break
        for s in full:
            found[s] = most * sizes[s]
        left -= sum(found[s] for s in full)
        open_ = [s for s in open_ if s not in found]
    return found


def sainte_lague(shares: list[float], seats: int) -> list[int]:
    """Seats by highest quotients share / (2 * seats held + 1), ties to the earlier."""
    total = sum(shares)
    if total <= 0 or seats <= 0:
        return [0] * len(shares)
    # the quotients that surely win are given at once: rounding down never overshoots by more
    # than the heap then corrects
    held = [max(0, int(s / total * seats) - 1) for s in shares]
    heap = [(-s / (2 * h + 1), i) for i, (s, h) in enumerate(zip(shares, held, strict=True)) if s > 0]
    heapq.heapify(heap)
    for _ in range(seats - sum(held)):
        _, i = heapq.heappop(heap)
        held[i] += 1
        heapq.heappush(heap, (-shares[i] / (2 * held[i] + 1), i))
    return held


def shard_quotas(shares: list[float], seats: int, shards: int) -> list[list[int]]:
    """Integer quotas of each shard: the apportionment of its seats on top of what the shards
    before it have, so that the shards' quotas add up to the apportionment of all seats."""
    out, done = [], [0] * len(shares)
    for i in range(1, shards + 1):
        now = sainte_lague(shares, seats * i // shards)
        # Sainte-Laguë is house monotone: no quota is negative
        out.append([a - b for a, b in zip(now, done, strict=True)])
        done = now
    return out


def levels(target: dict[str | None, float], names: list[str | None]) -> list[tuple[int, list[str | None]]]:
    """Words of a block and the sources of each level. A source whose target is less than
    LEAST_BLOCKS blocks is left to the next level, whose blocks are of its own sources' targets:
    each level shares at most a quarter of the words of the one before."""
    found: list[tuple[int, list[str | None]]] = []
    left, blocks = names, BLOCKS
    while left:
        total = sum(target[s] for s in left)
        block = max(1, int(total // max(blocks, LEVEL_BLOCKS * len(left))))
        small = [s for s in left if 0 < target[s] < LEAST_BLOCKS * block] if block > 1 else []
        found.append((block, [s for s in left if s not in small]))
        left, blocks = small, 0
    return found


def plan(spark: SparkSession, per_source: dict[str | None, int], weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """source, source_size, target, block_words and quotas (of each shard, in blocks, summed from
    the first) for every source. This is the driver's part: about two kilobytes a source."""
    names = sorted(per_source, key=lambda s: (s is None, s or ""))
    target = targets(per_source, weights, share, most)
    rows = []
    for block, own in levels(target, names):
        shares = [target[s] for s in own]
        quotas = np.array(shard_quotas(shares, round(sum(shares) / block), SHARDS), dtype=np.int64).reshape(SHARDS, len(own))
        rows += [(s, per_source[s], float(target[s]), block, of) for s, of in zip(own, np.cumsum(quotas, axis=0).T.tolist(), strict=True)]
    return spark.createDataFrame(rows, "source string, source_size long, target double, block_words long, quotas array<long>")


def chosen_blocks(sources: DataFrame, seed: int) -> DataFrame:
    """source, block, and for both passes: picked_0, before_0 (blocks picked before it), shard_0;
    picked_1, before_1, shard_1. Blocks are picked in a seeded order; the first ones fill the quota of the
    first shard, the next ones that of the second, on through the second pass. The last block of
    a source may be short; what is missing is made up for by one block more, for the last shard."""
    same = Window.partitionBy("source")
    words, size, quota = F.col("block_words"), F.col("source_size"), F.element_at("quotas", -1)
    blocks = sources.where("source_size > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(size / words).cast("long") - 1)))
    blocks = blocks.withColumn("words", F.least(words, size - F.col("block") * words)).withColumn("draw", F.xxhash64("source", "block", F.lit(seed)))
    drawn = same.orderBy("draw", "block")
    blocks = blocks.withColumns({"upto": F.sum("words").over(drawn.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "at": F.row_number().over(drawn) - 1})
    want = F.least((quota * words).cast("double"), F.col("target"))
    for p in (0, 1):
        of_pass = F.least(size.cast("double"), F.greatest(F.lit(0.0), want - p * size))
        blocks = blocks.withColumn(f"picked_{p}", F.col("upto") - F.col("words") / 2 <= of_pass)
    first = F.sum(F.col("picked_0").cast("long")).over(same)
    for p in (0, 1):
        blocks = blocks.withColumn(f"before_{p}", F.coalesce(F.sum(F.col(f"picked_{p}").cast("long")).over(same.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        number = F.col("at") + (first if p else F.lit(0))
        blocks = blocks.withColumn("number", number)
        full = F.size(F.filter("quotas", lambda q: q <= F.col("number")))
        blocks = blocks.withColumn(f"shard_{p}", F.when(F.col(f"picked_{p}"), F.least(full, F.lit(SHARDS - 1))))
    return blocks.select("source", "block", *[f"{c}_{p}" for p in (0, 1) for c in ("picked", "before", "shard")])


def word_count(text: str = "text"):
    """Words of a text without splitting it: changes from white space to other characters."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return F.length(F.regexp_replace(spaced, r"[\x20\x09-\x0D]+", "")).cast("long")


def mix(documents: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 20240607) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, first_taken, second_taken, start for every
    row of `documents` (doc_id, text, source).

    A source's documents stand in a seeded order on a line of words, cut into blocks of equal
    words; sources with small targets share smaller blocks of their own (`levels`). The mix takes each source's quota of blocks, picked in a seeded order: from one pass
    over the line, or all of it and blocks of a second pass where the target exceeds the source.
    taken counts a document's words in picked blocks of both passes, so it never exceeds `most`
    (2) times its size; a source's sum is within about a block of its target. A null source is a
    source of its own; null, empty and blank texts have size 0 and are taken 0 times; rows with a
    null doc_id or repeated rows are ordered by text. An empty table gives an empty result.

    Sources are summed by one aggregation; prefix sums run within RUNS hash runs of a source, so
    no source is ordered in one task. Tables of sources, runs and blocks don't grow with the words;
    they grow with the sources, so they are joined, and Spark broadcasts them only where small.
    Other columns, whatever their names, are ignored.
    """
    return _mixed(documents, weights, share, most, seed)[1].drop("h", "copy", "block_words")


def _hash(seed: int):
    return F.xxhash64("doc_id", "text", F.lit(seed))


def _mixed(documents: DataFrame, weights: tuple[int, ...], share: float, most: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """The chosen blocks, and every row with its place on its source's line."""
    spark = documents.sparkSession
    sized = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size"), _hash(seed).alias("h"))
    # rows that repeat everything are numbered
    sized = sized.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "h").orderBy("source")))
    sized = stored(sized.withColumn("run", F.pmod(F.shiftright("h", 20), F.lit(RUNS)).cast("int")), "mix-sizes")
    runs = sized.groupBy("source", "run").agg(F.sum("size").alias("words"))
    per_source = {r.source: r.n for r in runs.groupBy("source").agg(F.sum("words").alias("n")).collect()}
    sources = stored(plan(spark, per_source, weights, share, most), "mix-sources")
    chosen = stored(chosen_blocks(sources, seed), "mix-blocks")
    earlier = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("run_start", F.coalesce(F.sum("words").over(earlier), F.lit(0))).drop("words")
    own = Window.partitionBy("source", "run").orderBy("h", "doc_id", "copy").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        sized.withColumn("in_run", F.coalesce(F.sum("size").over(own), F.lit(0)))
        .join(runs.withColumnRenamed("source", "of").withColumnRenamed("run", "of_run"), F.col("source").eqNullSafe(F.col("of")) & (F.col("run") == F.col("of_run")))
        .select("doc_id", "h", "copy", "source", "size", (F.col("run_start") + F.col("in_run")).alias("start"))
    )
    placed = placed.withColumn("end", F.col("start") + F.col("size"))
    placed = placed.join(sources.drop("quotas").withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    length = F.col("block_words")
    # words picked before a place: whole blocks before it and a part of its own
    for edge in ("start", "end"):
        named = chosen.select(F.col("source").alias("of"), F.col("block").alias("of_block"), "picked_0", "before_0", "picked_1", "before_1")
        place = F.when(F.col(edge) > F.col("start"), F.col(edge) - 1).otherwise(F.col(edge))
        placed = placed.withColumn("at", F.floor(place / length).cast("long")).join(named, F.col("source").eqNullSafe(F.col("of")) & (F.col("at") == F.col("of_block")), "left")
        for p in (0, 1):
            placed = placed.withColumn(f"{edge}_{p}", F.coalesce(F.col(f"before_{p}"), F.lit(0)) * length + F.when(F.col(f"picked_{p}"), F.col(edge) - F.col("at") * length).otherwise(0))
        placed = placed.drop("at", "of", "of_block", "picked_0", "picked_1", "before_0", "before_1")
    # the last block of a line is short, which the places before its end don't need to know
    first, second = (F.when(F.col("size") > 0, F.col(f"end_{p}") - F.col(f"start_{p}")).otherwise(0).cast("long") for p in (0, 1))
    return chosen, placed.select("doc_id", "h", "copy", "source", "size", "source_size", "target", (first + second).alias("taken"), first.alias("first_taken"), second.alias("second_taken"), "start", "block_words")


def _parts(names: list[str], by_shard: bool):
    """Of rows (row, start, size, block_words, picks): the taken words in either pass, as texts."""
    at_text = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            given = b.column(0).flatten()
            starts, sizes, lengths, picks = (b.column(i).to_pylist() for i in range(1, 5))
            rows, texts, shards = [], [], []
            for w in _words.slices(given[at_text], lower=False, hashed=False):
                whole = w.data.tobytes()
                for i in range(w.first, w.stop):
                    start, size, block = starts[i], sizes[i], lengths[i]
                    at, first = w.heads[i - w.first], start // block
                    of = np.full((2, (start + size - 1) // block - first + 1), -1, dtype=np.int64)
                    for pick in picks[i]:
                        of[pick["pass"], pick["block"] - first] = pick["shard"] if by_shard else 0
                    for p in (0, 1):
                        for shard in np.unique(of[p][of[p] >= 0]):
                            own = of[p] == shard
                            rows.append(i)
                            shards.append(int(shard))
                            if own.all():
                                texts.append(whole[w.offsets[i - w.first] : w.offsets[i - w.first + 1]])
                                continue
                            edge = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]]))).reshape(-1, 2)
                            spans = [(max(0, (first + x) * block - start), min(size, (first + y) * block - start)) for x, y in edge]
                            texts.append(b"\n".join([whole[w.start[at + x] : w.end[at + y - 1]] for x, y in spans]))
            of_row = pa.array(rows, pa.int64())
            out = [pa.array(texts, pa.binary()).cast(pa.string()) if i == at_text else c.take(of_row) for i, c in enumerate(given)]
            if by_shard:
                out.append(pa.array(shards, pa.int32()))
            yield pa.RecordBatch.from_arrays(out, [*names, "shard"][: len(out)])

    return run


def mixed_documents(documents: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 20240607, by_shard: bool = False) -> DataFrame:
    """The mix of `mix` as documents: a row for each pass (by_shard: and each shard, in one more
    column `shard`) that takes words of a document, with the columns of `documents`, whatever their
    names, and the taken part as text: whole where all of it is taken, else the words of the
    picked blocks, parts on lines of their own. A document of which nothing is taken is left out;
    so are those without words (null, empty, blank). Rows with a null doc_id and rows that repeat
    others take part like any; an empty table gives an empty result. by_shard needs that no column
    is named shard."""
    chosen, placed = _mixed(documents, weights, share, most, seed)
    names = documents.columns
    placed = placed.where("taken > 0").withColumn("at", F.explode(F.sequence(F.floor(F.col("start") / F.col("block_words")), F.floor((F.col("start") + F.col("size") - 1) / F.col("block_words")))))
    one_pass = [F.when(F.col(f"picked_{p}"), F.struct(F.lit(p).alias("pass"), "block", f"shard_{p}")) for p in (0, 1)]
    one_pass = [x.cast("struct<pass:int,block:long,shard:int>") for x in one_pass]
    picks = chosen.select(F.col("source").alias("of"), F.col("block").alias("of_block"), F.filter(F.array(*one_pass), lambda x: x.isNotNull()).alias("picks"))
    placed = placed.join(picks, F.col("source").eqNullSafe(F.col("of")) & (F.col("at") == F.col("of_block")))
    placed = placed.groupBy("doc_id", "h", "copy").agg(F.first("start").alias("start"), F.first("size").alias("size"), F.first("block_words").alias("block_words"), F.flatten(F.collect_list("picks")).alias("picks"))
    keyed = documents.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id").cast("long").alias("of_id"), F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(seed)).alias("of_h"), F.col("source").cast("string").alias("of_source"))
    keyed = keyed.withColumn("of_copy", F.row_number().over(Window.partitionBy("of_id", "of_h").orderBy("of_source")))
    same = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("h") == F.col("of_h")) & (F.col("copy") == F.col("of_copy"))
    joined = keyed.join(placed, same).select("row", "start", "size", "block_words", "picks")
    schema = T.StructType([*documents.schema.fields, *([T.StructField("shard", T.IntegerType())] if by_shard else [])])
    return joined.mapInArrow(tidied(_parts(names, by_shard)), schema)
