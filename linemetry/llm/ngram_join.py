"""N-gram Jaccard join as a blocked sparse matrix product.

The incidence matrix has a row for each distinct shingle set and a column for each shingle.
Its product with its own transpose holds the overlaps of all pairs. Three steps keep it small:

1. Column blocks. Every shingle goes, six bytes packed, to the block of columns its number
   falls in; a block tells which of its columns have more than one row. Only such columns add
   to an overlap, so a row whose shared columns are fewer than the least overlap its size
   demands can't have a partner and is dropped. Columns that several rows of one flush have are
   known to be shared: one entry of each goes to the block, the others straight to their
   documents, so a column that very many rows have isn't gathered. Blocks are in proportion to
   the data; beyond 2**HOP_BITS of them entries go there in two hops, and are reduced in each.
2. Row blocks. The remaining columns are ordered by their number of rows; two rows that reach
   the bound share a column among the first `size - need + 1` of each (prefix bound). Rows
   connected by such columns form a cluster, cut into blocks in order of size.
3. Products. Each pair of blocks of a cluster is one task-sized cell: overlap counts are
   accumulated over column chunks and pairs are discarded as soon as count + what is left
   falls below the bound. A cell returns links of a spanning forest, never all pairs. Large
   clusters first multiply each block with itself and with the first block; then only rows
   outside the cluster's largest component are multiplied with the others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _words
from ._graph import components
from ._memory import tidied
from ._skew import join_hot
from ._tables import discard, stored

#: Shingles that are packed together before they are dealt to column blocks.
FLUSH = 1 << 20
#: Shingles that a column block holds on average, and bits of the blocks that one hop deals to (four at least).
BLOCK_GRAMS, HOP_BITS = 1 << 20, 12
#: Rows of a cell's side, and columns multiplied at once.
CELL_ROWS, CELL_COLUMNS = 512, 4096
#: Small clusters are put together in groups of about this many rows.
GROUP_ROWS = 256


def least_overlap(size: int, percent: int) -> int:
    """The overlap that any partner at Jaccard >= percent/100 must have with a set of `size`."""
    return -(-percent * size // 100)


def _sizes(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for w in _words.slices(b.column(1), lower=True):
                doc, gram = _words.shingle_sets(w, k)
                n = np.bincount(doc, minlength=w.stop - w.first)
                first, second = (_per_doc(_words.mix(gram, salt), n) for salt in (1, 2))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[w.first : w.stop].astype(np.int64), n.astype(np.int64), first, second)], ["doc_id", "n", "fp1", "fp2"])

    return run


def _per_doc(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of a document's values; values are in document order, n of them for each."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    ends = np.cumsum(n)
    return (total[ends] - total[ends - n]).view(np.int64)


def pack(gram: np.ndarray, size: int = 6) -> bytes:
    """The low 8 * `size` bits of each number."""
    return np.ascontiguousarray(gram.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def unpack(data: bytes, size: int = 6) -> np.ndarray:
    part = np.frombuffer(data, dtype=np.uint8).reshape(-1, size)
    out = np.zeros((len(part), 8), dtype=np.uint8)
    out[:, :size] = part
    return out.view("<u8").ravel().astype(np.uint64)


def pack_planes(values: np.ndarray) -> bytes:
    """Whole numbers as byte planes of their differences: small if they ascend or repeat."""
    step = np.diff(values.astype(np.int64), prepend=0)
    return np.ascontiguousarray(step.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_planes(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<i8").ravel())


_BLOCKED = "block int, kind int, docs binary, counts binary, grams binary"
_BLOCKED_TYPES = (pa.int32(), pa.int32(), *[pa.binary()] * 3)


def _packed(number: np.ndarray, ids: np.ndarray, gram: np.ndarray, size: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """Entries packed by `number`, in the order they have: number, documents, counts, grams."""
    order = np.argsort(number, kind="stable")
    number, ids, gram = number[order], ids[order], gram[order]
    cuts = np.flatnonzero(np.diff(number)) + 1
    for a, b in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(number)]]), strict=True):
        if b > a:
            heads = np.concatenate([[a], np.flatnonzero(np.diff(ids[a:b])) + 1 + a])
            yield int(number[a]), pack_planes(ids[heads]), pack_planes(np.diff(np.concatenate([heads, [b]]))), pack(gram[a:b], size)


def _bucket(ids: np.ndarray, bits: int) -> np.ndarray:
    return (_words.mix(ids.view(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.int64)


def _reduced(ids: np.ndarray, gram: np.ndarray, counted: np.ndarray, bits: int, bucket_bits: int) -> pa.RecordBatch:
    """Entries, ascending by document, as rows of _BLOCKED for 2**bits blocks. kind 0: an entry to
    be counted; 1: the one entry of a column that is known to be shared (as `counted` ones are);
    2: its other entries, dealt by their documents."""
    order = np.argsort(gram, kind="stable")
    ordered = gram[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    heads = np.flatnonzero(new)
    sizes = np.diff(np.concatenate([heads, [len(gram)]]))
    shared = np.repeat((sizes > 1) | np.logical_or.reduceat(counted[order], heads), sizes)
    kind = np.zeros(len(gram), dtype=np.int8)
    kind[order] = np.where(shared, np.where(new, 1, 2), 0)
    shift = np.uint64(_words.GRAM_BITS - bits)
    out = []
    for c in (0, 1):
        of = kind == c
        out += [(block, c, *rest) for block, *rest in _packed((gram[of] >> shift).astype(np.int64), ids[of], gram[of], 6)]
    of = kind == 2
    out += [(bucket, 2, *rest) for bucket, *rest in _packed(_bucket(ids[of], bucket_bits), ids[of], gram[of], 7)]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), _BLOCKED_TYPES, strict=True)], [x.split()[0] for x in _BLOCKED.split(", ")])


def _deal(k: int, bits: int, bucket_bits: int):
    """Deal shingles to 2**bits column blocks."""

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        ids, first, gram, n = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        # documents in order of their ids, which then pack well
        by, start = np.argsort(ids, kind="stable"), np.cumsum(n) - n
        ids, first, start, n = ids[by], first[by], start[by], n[by]
        gram = gram[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(len(gram))]
        # of rows with equal sets in this flush, the one with the smallest id stands for all
        order = np.lexsort((ids, first))
        keep = order[np.concatenate([[True], np.diff(first[order]) != 0])]
        kept = np.zeros(len(ids), dtype=bool)
        kept[keep] = True
        owner = np.repeat(np.arange(len(ids), dtype=np.uint32), n)
        gram, owner = gram[kept[owner]], owner[kept[owner]]
        if len(gram):
            yield _reduced(ids[owner], gram, np.zeros(len(gram), dtype=bool), bits, bucket_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for w in _words.slices(b.column(1), lower=True):
                doc, gram = _words.shingle_sets(w, k)
                n = np.bincount(doc, minlength=w.stop - w.first)
                first = _per_doc(_words.mix(gram, 1), n)
                some = n > 0
                held.append((ids[w.first : w.stop][some], first[some], gram, n[some]))
                size += len(gram)
                if size >= FLUSH:
                    yield from flush(held)
                    size = 0
        if size:
            yield from flush(held)

    return run


def _deal_on(hop_bits: int, bits: int):
    """Of rows of _BLOCKED that stand together by block of `hop_bits`: the entries reduced again
    and dealt to blocks of `bits`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, of = [], 0, -1

        def flush() -> pa.RecordBatch:
            ids, gram, counted = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(ids, kind="stable")
            return _reduced(ids[order], gram[order], counted[order], bits, bits)

        for b in batches:
            kinds = b.column("kind").to_numpy()
            if (kinds == 2).any():
                yield b.filter(pa.array(kinds == 2))
            rows = b.filter(pa.array(kinds < 2))
            for block, kind, docs, counts, grams in zip(*(rows.column(c).to_pylist() for c in ("block", "kind", "docs", "counts", "grams")), strict=True):
                if held and (block != of or size >= FLUSH):
                    yield flush()
                    size = 0
                of = block
                ids = np.repeat(unpack_planes(docs), unpack_planes(counts))
                held.append((ids, _whole(grams, block, hop_bits), np.full(len(ids), kind == 1)))
                size += len(ids)
        if held:
            yield flush()

    return run


def _shared(bits: int):
    """Of one column block, the entries whose column has several rows, packed by bucket of documents."""

    def run(table: pa.Table) -> pa.Table:
        kinds, ids, grams = [], [], []
        for block, kind, docs, counts, packed in zip(*(table.column(c).to_pylist() for c in ("block", "kind", "docs", "counts", "grams")), strict=True):
            gram = unpack(packed, 7) if kind == 2 else _whole(packed, block, bits)
            ids.append(np.repeat(unpack_planes(docs), unpack_planes(counts)))
            kinds.append(np.full(len(gram), kind, dtype=np.int8))
            grams.append(gram)
        kind, doc, gram = np.concatenate(kinds), np.concatenate(ids), np.concatenate(grams)
        order = np.argsort(gram, kind="stable")
        ordered = gram[order]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        keep = np.concatenate([~new[1:], [False]]) | ~new | (kind[order] > 0)
        doc, gram = doc[order][keep], ordered[keep]
        order = np.argsort(doc, kind="stable")
        doc, gram = doc[order], gram[order]
        out = list(_packed(_bucket(doc, bits), doc, gram, 7))
        kinds = (pa.int32(), *[pa.binary()] * 3)
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["bucket", "docs", "counts", "grams"])

    return run


def _whole(packed: bytes, block: int, bits: int) -> np.ndarray:
    """Shingles' numbers from their low 48 bits and their block, which has the others."""
    shift = np.uint64(_words.GRAM_BITS - bits)
    return unpack(packed) & ((np.uint64(1) << shift) - np.uint64(1)) | np.uint64(block) << shift


def _gathered(table: pa.Table) -> pa.Table:
    """Of one bucket of documents: the shared columns of each, from all blocks."""
    docs, grams = [], []
    for d, c, g in zip(*(table.column(x).to_pylist() for x in ("docs", "counts", "grams")), strict=True):
        docs.append(np.repeat(unpack_planes(d), unpack_planes(c)))
        grams.append(unpack(g, 7))
    doc, gram = np.concatenate(docs), np.concatenate(grams)
    order = np.lexsort((gram, doc))
    doc, gram = doc[order], gram[order]
    heads = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([heads, [len(doc)]]).astype(np.int32)), pa.array(gram.view(np.int64)))
    return pa.table([pa.array(doc[heads]), lists], ["doc_id", "grams"])


class Forest:
    """Union-find over small integers; remembers the links that joined two trees."""

    def __init__(self, n: int) -> None:
        self.parent, self.links = np.arange(n), []

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
            self.links.append((a, b))


def product(left: list[np.ndarray], left_n: np.ndarray, right: list[np.ndarray], right_n: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of left, row of right) with 100 * overlap >= percent * union, block by block.

    left and right hold each row's columns, left_n and right_n the sizes of the whole sets.
    Counts are sums of at most 2**24 ones in single precision, so they are exact.
    """
    names, column = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    lens = np.array([len(x) for x in (*left, *right)])
    row = np.repeat(np.arange(len(lens)), lens)
    m = len(left)
    both = np.zeros((2, len(names)), dtype=bool)
    both[0, column[row < m]] = both[1, column[row >= m]] = True
    live = both.all(axis=0)  # columns that both sides have
    row, column = row[live[column]], (np.cumsum(live) - 1)[column[live[column]]]
    left_n, right_n = np.asarray(left_n, dtype=np.int64), np.asarray(right_n, dtype=np.int64)
    # 100 o >= p (a + b - o)  <=>  o >= p (a + b) / (100 + p)
    need = (-(-percent * (left_n[:, None] + right_n[None, :]) // (100 + percent))).astype(np.float32)
    count = np.zeros_like(need)
    left_rest = np.bincount(row[row < m], minlength=m).astype(np.float32)
    right_rest = np.bincount(row[row >= m] - m, minlength=len(right)).astype(np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for a in range(0, int(live.sum()), CELL_COLUMNS):
        alive = count + np.minimum(left_rest[:, None], right_rest[None, :]) >= need
        if not alive.any():
            return
        part = slice(*np.searchsorted(column, [a, a + CELL_COLUMNS]))
        dense = np.zeros((len(lens), min(CELL_COLUMNS, int(live.sum()) - a)), dtype=np.float32)
        dense[row[part], column[part] - a] = 1
        x, y = dense[:m], dense[m:]
        count += x @ y.T
        left_rest -= x.sum(axis=1)
        right_rest -= y.sum(axis=1)
    yield np.nonzero((count >= need) & (count > 0))


def _cells(percent: int):
    """Multiply the cells of one group; rows: cell, side (0 left, 1 right, 2 both), doc_id, n, root, grams."""

    def run(table: pa.Table) -> pa.Table:
        out_a, out_b = [], []
        cells = table.column("cell").to_numpy()
        side, ids, n, root = (table.column(c).to_numpy() for c in ("side", "doc_id", "n", "root"))
        lists = table.column("grams").combine_chunks()
        heads, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        order = np.argsort(cells, kind="stable")
        cuts = np.flatnonzero(np.diff(cells[order])) + 1
        for of in np.split(order, cuts):
            of = of[np.lexsort((ids[of], n[of]))]
            left, right = of[side[of] != 1], of[side[of] != 0]
            number = {int(d): i for i, d in enumerate(dict.fromkeys(ids[of].tolist()))}
            forest, known = Forest(len(number)), {}
            for i in of:  # what is connected already needs no link again
                forest.join(known.setdefault(int(root[i]), number[int(ids[i])]), number[int(ids[i])])
            forest.links.clear()
            name = list(number)
            for a in range(0, len(left), CELL_ROWS):
                for b in range(0, len(right), CELL_ROWS):
                    x, y = left[a : a + CELL_ROWS], right[b : b + CELL_ROWS]
                    if 100 * n[x[-1]] < percent * n[y[0]] or 100 * n[y[-1]] < percent * n[x[0]]:
                        continue
                    if side[x[0]] == 2 == side[y[0]] and a > b:
                        continue
                    for i, j in product([values[heads[r] : heads[r + 1]] for r in x], n[x], [values[heads[r] : heads[r + 1]] for r in y], n[y], percent):
                        for p, q in zip(ids[x[i]].tolist(), ids[y[j]].tolist(), strict=True):
                            if p != q:
                                forest.join(number[p], number[q])
            out_a += [name[p] for p, _ in forest.links]
            out_b += [name[q] for _, q in forest.links]
        return pa.table([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return run


def _clusters(rows: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of the stored table (doc_id, n, grams), which is discarded: those that may have a partner, with exact shared columns, and
    the cluster of each."""
    entries = rows.select("doc_id", F.explode("grams").alias("gram"))
    often = stored(entries.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1"), "ngram-columns")
    need = F.ceil(F.col("n") * percent / F.lit(100.0)).cast("int")
    by_df = F.sort_array(F.collect_list(F.struct("df", "gram")))
    kept = join_hot(entries, often, ["gram"], "df").groupBy("doc_id").agg(by_df["gram"].alias("grams"))
    kept = stored(kept.join(rows.select("doc_id", "n"), "doc_id").where(F.size("grams") >= need), "ngram-rows")
    discard(often, rows)
    # the columns that a row has alone come first in the order, so they use up the prefix first
    prefix = kept.select("doc_id", F.explode(F.slice("grams", F.lit(1), F.size("grams") - need + 1)).alias("gram"))
    pivot = stored(prefix.groupBy("gram").agg(F.min("doc_id").alias("a"), F.count("*").alias("rows")), "ngram-pivots")
    edges = join_hot(prefix, pivot, ["gram"], "rows").where("doc_id <> a").select("a", F.col("doc_id").alias("b"))
    clusters = components(edges, "ngram-clusters")
    discard(pivot)
    return kept, clusters


def _members(rows: DataFrame) -> DataFrame:
    return stored(rows.groupBy("cluster").agg(F.count("*").alias("members")), "ngram-members")


def _links(kept: DataFrame, clusters: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of a spanning forest of every component."""
    schema = "a long, b long"
    rows = kept.join(clusters.withColumnRenamed("node", "doc_id").withColumnRenamed("root", "cluster"), "doc_id")
    rows = join_hot(rows, _members(rows), ["cluster"], "members")
    small = rows.where(F.col("members") <= CELL_ROWS).select(
        F.xxhash64("cluster").alias("group"), F.col("cluster").alias("cell"), F.lit(2).alias("side"), "doc_id", "n", F.col("doc_id").alias("root"), "grams", "members"
    )
    groups = max(1, math.ceil((small.count() or 1) / GROUP_ROWS))
    small = small.withColumn("group", F.pmod("group", F.lit(groups)))
    found = stored(small.drop("members").groupBy("group").applyInArrow(_cells(percent), schema), "ngram-links")

    large = rows.where(F.col("members") > CELL_ROWS)
    if not large.take(1):
        return found
    large = stored(_blocked(large), "ngram-large")
    block = large.select(F.xxhash64("cluster", "block").alias("group"), F.xxhash64("cluster", "block").alias("cell"), "block", "cluster", "doc_id", "n", "grams")
    count = large.groupBy("cluster").agg(F.max("block").alias("last"))
    own = block.select("group", "cell", F.lit(2).alias("side"), "doc_id", "n", F.col("doc_id").alias("root"), "grams")
    first = (
        block.where("block > 0")
        .select(F.xxhash64("group", F.lit(1)).alias("group"), F.lit(0).alias("side"), "doc_id", "n", "grams")
        .unionByName(
            block.where("block = 0").join(count, "cluster").select(F.explode(F.sequence(F.lit(1), F.greatest("last", F.lit(1)))).alias("other"), "cluster", "doc_id", "n", "grams", "last")
            .where("other <= last")
            .select(F.xxhash64(F.xxhash64("cluster", F.col("other")), F.lit(1)).alias("group"), F.lit(1).alias("side"), "doc_id", "n", "grams")
        )
        .select("group", F.col("group").alias("cell"), "side", "doc_id", "n", F.col("doc_id").alias("root"), "grams")
    )
    step = stored(own.unionByName(first).groupBy("group").applyInArrow(_cells(percent), schema), "ngram-links")

    roots = components(step, "ngram-step")
    rooted = large.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    sizes = rooted.groupBy("cluster", "root").agg(F.count("*").alias("size"))
    most = sizes.groupBy("cluster").agg(F.max(F.struct("size", F.col("root").alias("main"))).alias("most"), F.sum("size").alias("rows")).select("cluster", "most.main", "rows")
    rooted = stored(join_hot(rooted, stored(most, "ngram-mains"), ["cluster"], "rows").drop("rows"), "ngram-rooted")
    minor = rooted.where("root <> main").drop("block", "members", "main")
    minor = stored(_blocked(join_hot(minor, _members(minor), ["cluster"], "members")), "ngram-minor")
    # cells only where sizes allow a link
    bounds = lambda df, p: df.groupBy("cluster", F.col("block").alias(p)).agg(F.min("n").alias(f"{p}_min"), F.max("n").alias(f"{p}_max"))
    cells = bounds(minor, "i").join(bounds(rooted, "j"), "cluster").where((F.col("i_max") * 100 >= F.col("j_min") * percent) & (F.col("j_max") * 100 >= F.col("i_min") * percent)).select("cluster", "i", "j", F.xxhash64("cluster", "i", "j").alias("group"))
    sides = [
        df.join(cells.withColumnRenamed(key, "block"), ["cluster", "block"]).select("group", F.col("group").alias("cell"), F.lit(s).alias("side"), "doc_id", "n", "root", "grams")
        for df, key, s in ((minor, "i", 0), (rooted, "j", 1))
    ]
    last = stored(sides[0].unionByName(sides[1]).groupBy("group").applyInArrow(_cells(percent), schema), "ngram-links")
    return found.union(step).union(last)


def _blocked(rows: DataFrame) -> DataFrame:
    """Blocks of about CELL_ROWS rows of a cluster (`members` rows), in order of size; without a
    sort of the whole cluster in one task: sizes are grouped first, large groups are cut by hash."""
    by_size = rows.groupBy("cluster", "members", "n").agg(F.count("*").alias("of_size"))
    before = F.sum("of_size").over(Window.partitionBy("cluster").orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    by_size = stored(by_size.withColumn("before", F.coalesce(before, F.lit(0))).select("cluster", "n", "of_size", "before"), "ngram-sizes-of")
    place = F.col("before") + F.pmod(F.xxhash64("doc_id"), F.col("of_size"))
    return (
        join_hot(rows.drop("block"), by_size, ["cluster", "n"], "of_size")
        .withColumn("block", F.floor(place / CELL_ROWS).cast("int"))
        .drop("of_size", "before")
    )


def ngram_join(documents: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of `documents` (doc_id, text).

    Sets are the distinct k-word shingles of the lower-cased (A-Z) text; a text of fewer words
    has its whole sequence as one shingle; null, empty and blank texts have an empty set, which
    is linked with nothing. Documents link when 100 * overlap >= percent * union. component_id
    is the smallest doc_id reachable by links, the document itself included. Rows with a null
    doc_id are left out; rows that repeat a doc_id give a row each, with the size of their own text. An
    empty table gives an empty result. Other columns, whatever their names, are ignored.
    Shingles are told apart by a 52-bit hash, equal sets of one flush by 64 bits, of all by 128.
    """
    docs = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sizes = stored(docs.mapInArrow(tidied(_sizes(k)), "doc_id long, n long, fp1 long, fp2 long"), "ngram-sizes")
    classes = sizes.where("n > 0").groupBy("n", "fp1", "fp2").agg(F.min("doc_id").alias("rep"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    bits = max(4, math.ceil(math.log2(max(1, total / BLOCK_GRAMS))))
    hop_bits = min(HOP_BITS, bits)
    dealt = docs.mapInArrow(tidied(_deal(k, hop_bits, bits)), _BLOCKED)
    if bits > hop_bits:
        dealt = dealt.repartition("block").sortWithinPartitions("block").mapInArrow(tidied(_deal_on(hop_bits, bits)), _BLOCKED)
    shared = dealt.groupBy("block").applyInArrow(_shared(bits), "bucket int, docs binary, counts binary, grams binary")
    shared = shared.groupBy("bucket").applyInArrow(_gathered, "doc_id long, grams array<long>")
    reps = classes.select(F.col("rep").alias("doc_id"), "n").distinct()
    rows = stored(shared.join(reps, "doc_id").where(F.size("grams") >= F.ceil(F.col("n") * percent / F.lit(100.0))).select("doc_id", "n", "grams"), "ngram-shared")
    kept, clusters = _clusters(rows, percent)
    roots = components(_links(kept, clusters, percent), "ngram-components")
    # a document is in the component of its class
    member = classes.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select("n", "fp1", "fp2", F.coalesce("root", "rep").alias("component_id"))
    return sizes.join(member, ["n", "fp1", "fp2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
