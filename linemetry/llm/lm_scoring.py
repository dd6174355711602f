"""LM scoring with a log-bilinear model trained by noise-contrastive estimation.

The TOP_WORDS most frequent words and the end of a text have vectors of their own; every other
word shares those of its cluster, given by the word's last two bytes. The model is factored: from
the two tokens before it, it predicts a class, and inside the class the token. The CLASS_WORDS most
frequent words and the end are classes by themselves, every cluster is one. Both factors are
log-bilinear, score = (R1[u-1] + R2[u-2]) . Q[u] + b[u], with their own Q and b, and are normalised
by batched matrix products. A word without vectors then has probability (c + 0.1) / (C + 0.1 * (W +
1)) in the rest of its cluster, with c its training count and C, W the training tokens and words
of that rest; so each cluster has a slot for unknown words, and all probabilities after a context
add up to 1. The model's size is bounded by parameters; counts are of all training documents.

Texts are tokenised twice: once to count words, once to numbers that are stored. Training is
distributed: tokens are dealt to parts by hashes of their documents, about PART_TOKENS each; every
part runs noise-contrastive estimation in numpy, from the same parameters, and the results are
averaged by tokens, in groups. A third of the parts gives the first average, from which the others
go on. Every training token is used once. Seeds and orders come from the data, not from tasks.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._memory import tidied
from ._runs import kinds as byte_kinds
from ._runs import runs
from ._tables import discard, stored
from ._words import mix

#: Sizes of the model: words with own vectors (at most), of these with own classes, clusters, dimensions.
TOP_WORDS, CLASS_WORDS, CLUSTERS, DIMENSIONS = 16_384, 128, 128, 12
#: Training: tokens of a step, noise classes of a step, noise words of a token, step size, seed.
STEP, NOISE, INNER_NOISE, RATE, SEED = 8192, 16, 2, 0.15, 20240607
#: Tokens of a part on average, and models averaged together.
PART_TOKENS, MODELS = 1 << 21, 16
#: Tokens that are counted or scored together, and rare (document, word) pairs of a block.
FLUSH, BLOCK_PAIRS = 1 << 21, 1 << 20
#: Frequencies are told apart in steps of 1 / LOG_STEPS of their natural logarithm to find the most frequent words.
LOG_STEPS = 32
_KIND = byte_kinds(b" \t\n\v\f\r")
#: Bytes of text that are split at once, and counted words that a task holds before it sends them on.
SLICE_BYTES, HELD = 1 << 20, 1 << 20
#: Contexts of a matrix product, whose scores stay in the cache.
BATCH = 256
LN10 = math.log(10)


def cluster(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % CLUSTERS


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            whole = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])
            yield from whole.combine_chunks().to_batches(1 << 16)

    for b in batches:
        for r in runs(b.column(0), _KIND, SLICE_BYTES):
            coded = r.words.dictionary_encode()
            n = np.bincount(coded.indices.to_numpy(zero_copy_only=False), minlength=len(coded.dictionary))
            held.append(pa.table([coded.dictionary.cast(pa.binary()), pa.array(n, pa.int64())], ["word", "n"]))
            rows += len(n)
            if rows >= HELD:
                yield from flush()
                held, rows = [], 0
    yield from flush()


class Lexicon:
    """Numbers of tokens: the top words by frequency, the end, then the rest of each cluster; the
    text's begin is one more, as context only."""

    def __init__(self, top: list[tuple[bytes, int]], ends: int, rest_tokens: np.ndarray, rest_words: np.ndarray) -> None:
        self.words = pa.array([w.decode() for w, _ in top], pa.large_string())
        self.end, self.first_rest = len(top), len(top) + 1
        self.begin = self.first_rest + CLUSTERS
        own = min(CLASS_WORDS, len(top))
        self.classes = own + 1 + CLUSTERS
        group = np.array([cluster(w) for w, _ in top[own:]], dtype=np.int64)
        rest = np.arange(CLUSTERS)
        self.class_of = np.concatenate([np.arange(own), own + 1 + group, [own], own + 1 + rest]).astype(np.int32)
        count = np.array([n for _, n in top] + [ends], dtype=np.float64)
        self.log_count, self.known = np.log10(count + 0.1), count > 0
        rest_mass = rest_tokens + 0.1 * (rest_words + 1)
        self.log_rest = np.log10(rest_mass)
        # inside the clusters: words in order of their cluster, then its rest
        of = np.concatenate([group, rest])
        mass = np.concatenate([count[own:-1] + 0.1, rest_mass])
        order = np.argsort(of, kind="stable")
        self.inner = np.full(self.begin, -1, dtype=np.int32)
        self.inner[np.concatenate([np.arange(own, len(top)), self.first_rest + rest])[order]] = np.arange(len(of))
        self.bounds = np.searchsorted(of[order], np.arange(CLUSTERS + 1))
        self.first_cluster = own + 1
        whole = np.bincount(of, weights=mass, minlength=CLUSTERS)
        self.share = mass[order] / whole[of[order]]
        class_mass = np.concatenate([count[:own] + 0.1, count[-1:] + 0.1, whole])
        self.noise = class_mass / class_mass.sum()

    def shapes(self) -> list[tuple[str, tuple[int, ...]]]:
        n = len(self.share)
        return [("r1", (self.begin + 1, DIMENSIONS)), ("r2", (self.begin + 1, DIMENSIONS)), ("q", (self.classes, DIMENSIONS)), ("b", (self.classes,)), ("qi", (n, DIMENSIONS)), ("bi", (n,))]

    def start(self) -> dict[str, np.ndarray]:
        rng = np.random.default_rng(SEED)
        first = {"b": np.log(self.noise), "bi": np.log(self.share)}
        return {k: (first[k] if k in first else rng.normal(0, 0.1, shape)).astype(np.float32) for k, shape in self.shapes()}

    def pack(self, model: dict[str, np.ndarray]) -> bytes:
        return np.concatenate([model[k].ravel() for k, _ in self.shapes()]).astype("<f4").tobytes()

    def unpack(self, data: bytes) -> dict[str, np.ndarray]:
        flat, out, at = np.frombuffer(data, "<f4"), {}, 0
        for k, shape in self.shapes():
            n = int(np.prod(shape))
            out[k] = flat[at : at + n].reshape(shape).copy()
            at += n
        return out


def contexts(code: np.ndarray, doc: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens one and two places before each token of the same document, else `begin`."""
    one, two = np.full(len(code), begin, dtype=np.int32), np.full(len(code), begin, dtype=np.int32)
    same = doc[1:] == doc[:-1]
    one[1:][same] = code[:-1][same]
    same = doc[2:] == doc[:-2]
    two[2:][same] = code[:-2][same]
    return one, two


def _scatter(table: np.ndarray, squares: np.ndarray, at: np.ndarray, grad: np.ndarray, rate: float) -> None:
    """An AdaGrad step on the rows `at`, which may repeat; numbers below 65,536, which are sorted by their bytes."""
    at = at.astype(np.uint16)
    order = np.argsort(at, kind="stable")
    rows = at[order]
    heads = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    total = np.add.reduceat(grad[order], heads, axis=0)
    rows = rows[heads]
    squares[rows] += total * total
    table[rows] += rate * total / (np.sqrt(squares[rows]) + 1e-6)


class Trainer:
    """Noise-contrastive estimation, a step at a time. Noise classes are shared by a step's tokens;
    inside a cluster each token has noise words of its own."""

    def __init__(self, lexicon: Lexicon, model: dict[str, np.ndarray], seed: int) -> None:
        self.of, self.model, self.squares = lexicon, model, {k: np.full_like(v, 1e-2) for k, v in model.items()}
        self.log_noise = np.log(NOISE * lexicon.noise).astype(np.float32)
        self.log_inner = np.log(INNER_NOISE * lexicon.share).astype(np.float32)
        self.rng = np.random.default_rng(seed)
        self.cum, self.inner_cum = np.cumsum(lexicon.noise), np.cumsum(lexicon.share)

    def step(self, code: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        m, s, of = self.model, self.squares, self.of
        h = m["r1"][one] + m["r2"][two]
        # the class
        of_class = of.class_of[code]
        noise = np.minimum(np.searchsorted(self.cum, self.rng.random(NOISE)), of.classes - 1)
        q, qn = m["q"][of_class], m["q"][noise]
        data = 1 / (1 + np.exp(np.einsum("ij,ij->i", h, q) + m["b"][of_class] - self.log_noise[of_class]))
        fake = -1 / (1 + np.exp(-(h @ qn.T + m["b"][noise] - self.log_noise[noise])))
        grad_h = data[:, None] * q + fake @ qn
        at = np.concatenate([of_class, noise])
        grads = [("b", at, np.concatenate([data, fake.sum(axis=0)])), ("q", at, np.concatenate([data[:, None] * h, fake.T @ h]))]
        # the word in its cluster
        inside = np.flatnonzero(of.inner[code] >= 0)
        if len(inside):
            word, hi = of.inner[code[inside]], h[inside]
            first = of.bounds[of_class[inside] - of.first_cluster]
            before = np.where(first > 0, self.inner_cum[first - 1], 0.0)
            # a cluster's shares add up to 1, so its words lie in [before, before + 1)
            drawn = np.searchsorted(self.inner_cum, before[:, None] + self.rng.random((len(word), INNER_NOISE)))
            drawn = np.minimum(drawn, (of.bounds[of_class[inside] - of.first_cluster + 1] - 1)[:, None])
            both = np.concatenate([word[:, None], drawn], axis=1)
            qb = m["qi"][both]
            score = np.einsum("ij,ikj->ik", hi, qb) + m["bi"][both] - self.log_inner[both]
            error = -1 / (1 + np.exp(-score))
            error[:, 0] += 1
            grad_h[inside] += np.einsum("ik,ikj->ij", error, qb)
            grads += [("bi", both.ravel(), error.ravel()), ("qi", both.ravel(), (error[:, :, None] * hi[:, None, :]).reshape(-1, DIMENSIONS))]
        for k, at, grad in (*grads, ("r1", one, grad_h), ("r2", two, grad_h)):
            _scatter(m[k], s[k], at, grad, RATE)


def log10_probabilities(lex: Lexicon, model: dict[str, np.ndarray], code: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """log10 of the model's probability of each token after two others; a cluster's rest as one token."""
    pair, back = np.unique(one.astype(np.int64) * (lex.begin + 1) + two, return_inverse=True)
    of_class = lex.class_of[code]
    first, second = pair // (lex.begin + 1), pair % (lex.begin + 1)
    lp = -_log_sums(model, first, second, model["q"], model["b"])[back]
    for a in range(0, len(code), 1 << 16):
        s = slice(a, a + (1 << 16))
        lp[s] += np.einsum("ij,ij->i", model["r1"][one[s]] + model["r2"][two[s]], model["q"][of_class[s]]) + model["b"][of_class[s]]
    inside = np.flatnonzero(lex.inner[code] >= 0)
    inside = inside[np.argsort(of_class[inside], kind="stable")]
    group = of_class[inside] - lex.first_cluster
    cuts = np.searchsorted(group, np.arange(CLUSTERS + 1))
    for c in np.unique(group):
        at = inside[cuts[c] : cuts[c + 1]]
        own = slice(lex.bounds[c], lex.bounds[c + 1])
        word = lex.inner[code[at]]
        pairs, same = np.unique(back[at], return_inverse=True)  # a context's sum is the same for all its words
        lp[at] -= _log_sums(model, first[pairs], second[pairs], model["qi"][own], model["bi"][own])[same]
        lp[at] += np.einsum("ij,ij->i", model["r1"][one[at]] + model["r2"][two[at]], model["qi"][word]) + model["bi"][word]
    return lp / LN10


def _log_sums(model: dict[str, np.ndarray], one: np.ndarray, two: np.ndarray, q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log of the sum over q's rows of exp(score), by batched matrix products. The bias is a dimension of its own;
    only where the sum leaves the range of the numbers, the greatest score is taken out first."""
    out, qt, ones = np.empty(len(one), dtype=np.float64), np.ascontiguousarray(np.concatenate([q.T, b[None]])), np.ones(len(q), dtype=np.float32)
    context, scores = np.ones((BATCH, DIMENSIONS + 1), dtype=np.float32), np.empty((BATCH, len(q)), dtype=np.float32)
    for a in range(0, len(one), BATCH):
        n = min(BATCH, len(one) - a)
        np.add(model["r1"][one[a : a + n]], model["r2"][two[a : a + n]], out=context[:n, :-1])
        s = np.matmul(context[:n], qt, out=scores[:n])
        with np.errstate(over="ignore"):
            total = np.exp(s, out=s) @ ones
        far = np.flatnonzero(~((total > 1e-30) & (total < 1e30)))
        with np.errstate(divide="ignore", invalid="ignore"):
            out[a : a + n] = np.log(total)
        if len(far):
            s = context[far].astype(np.float64) @ qt
            top = s.max(axis=1)
            out[a + far] = top + np.log(np.exp(s - top[:, None]).sum(axis=1))
    return out


_NUMBERED = "row long, doc_id long, train boolean, held_out boolean, n long, codes binary, rare binary"


def _numbered(lexicon):
    """Of rows (row, doc_id, train, held_out, text): tokens as numbers, and the words without vectors."""
    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.binary(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex: Lexicon = lexicon.value
        # the rest's number by the last two bytes, after those of single bytes
        rest = lex.first_rest + np.array([*(cluster(bytes([x])) for x in range(256)), *(cluster(bytes([x, y])) for x in range(256) for y in range(256))])
        for b in batches:
            for r in runs(b.column(4), _KIND, SLICE_BYTES):
                ends, data = np.frombuffer(r.words.buffers()[1], dtype=np.int64), np.frombuffer(r.words.buffers()[2] or b"", dtype=np.uint8).astype(np.int64)
                last, size = ends[1:] - 1, np.diff(ends)
                tail = np.where(size > 1, 256 + 256 * data[np.maximum(last - 1, 0)] + data[last], data[last]) if len(last) else last
                code = pc.fill_null(pc.index_in(r.words, lex.words), -1).to_numpy(zero_copy_only=False)
                without = code < 0
                counts = np.bincount(r.doc, minlength=r.size)
                whole = np.full(len(code) + r.size, lex.end, dtype="<u2")
                whole[np.arange(len(code)) + r.doc] = np.where(without, rest[tail], code)
                cuts = np.concatenate([[0], np.cumsum(2 * (counts + 1))]).astype(np.int32)
                codes = pa.BinaryArray.from_buffers(pa.binary(), r.size, [None, pa.py_buffer(cuts), pa.py_buffer(whole)])
                of = np.concatenate([[0], np.cumsum(np.bincount(r.doc[without], minlength=r.size))])
                rare = pc.binary_join(pa.ListArray.from_arrays(pa.array(of, pa.int32()), r.words.filter(pa.array(without)).cast(pa.binary())), b" ")
                columns = [*[b.column(i).slice(r.first, r.size) for i in range(4)], pa.array(counts + 1), codes, rare]
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in _NUMBERED.split(", ")])

    return run


def _train(lexicon, start):
    """The model that one part's tokens make of `start`."""

    def run(table: pa.Table) -> pa.Table:
        lex: Lexicon = lexicon.value
        table = table.sort_by([("order", "ascending")])
        part = table.column("part")[0].as_py()
        trainer, seen, held, size = Trainer(lex, lex.unpack(start.value), SEED + part), 0, [], 0

        def steps() -> None:
            nonlocal seen
            code = np.concatenate(held).astype(np.int32)
            one, two = contexts(code, np.repeat(np.arange(len(held)), [len(x) for x in held]), lex.begin)
            order = trainer.rng.permutation(len(code))
            for a in range(0, len(order), STEP):
                at = order[a : a + STEP]
                trainer.step(code[at], one[at], two[at])
            seen += len(code)

        for codes in table.column("codes"):
            held.append(np.frombuffer(codes.as_py(), "<u2"))
            size += len(held[-1])
            if size >= FLUSH // 8:
                steps()
                held, size = [], 0
        if held:
            steps()
        return pa.table([pa.array([part], pa.int64()), pa.array([seen], pa.int64()), pa.array([lex.pack(trainer.model)], pa.binary())], ["part", "n", "model"])

    return run


def _average(table: pa.Table) -> pa.Table:
    table = table.sort_by([("part", "ascending")])
    n = table.column("n").to_numpy().astype(np.float64)
    total = sum(np.frombuffer(m.as_py(), "<f4").astype(np.float64) * x for m, x in zip(table.column("model"), n, strict=True))
    part = table.column("part")[0].as_py() // MODELS
    return pa.table([pa.array([part], pa.int64()), pa.array([int(n.sum())], pa.int64()), pa.array([(total / n.sum()).astype("<f4").tobytes()], pa.binary())], ["part", "n", "model"])


def _averaged(models: DataFrame) -> bytes | None:
    """The models' average by tokens, MODELS at a time, so neither a task nor the driver gets all."""
    models = stored(models, "lm-models")
    while models.count() > 1:
        fewer = stored(models.groupBy(F.floor(F.col("part") / MODELS)).applyInArrow(_average, "part long, n long, model binary"), "lm-models")
        discard(models)
        models = fewer
    found = models.first()
    discard(models)
    return bytes(found.model) if found else None


_DEALT = "block int, docs binary, train binary, counts binary, names binary, words binary, times binary, sums binary"


def _score(lexicon, trained, blocks: int):
    """Of rows of _NUMBERED: partial sums of each (block rows with `sums`), and the words without
    vectors dealt to blocks."""
    names = [x.split()[0] for x in _DEALT.split(", ")]
    kinds = (pa.int32(), *[pa.binary()] * 7)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex: Lexicon = lexicon.value
        model = lex.unpack(trained.value)
        log_count = np.concatenate([lex.log_count, np.zeros(CLUSTERS)])
        known_code = np.concatenate([lex.known, np.zeros(CLUSTERS, dtype=bool)])
        within = np.concatenate([np.zeros(lex.first_rest), -lex.log_rest])

        def flush() -> pa.RecordBatch:
            rows, ids, held_out, train, codes, rare = zip(*held, strict=True)
            n = np.array([len(c) for c in codes])
            code, doc = np.concatenate(codes).astype(np.int32), np.repeat(np.arange(len(n)), n)
            one, two = contexts(code, doc, lex.begin)
            lp = log10_probabilities(lex, model, code, one, two) + within[code]
            of = lambda x: np.bincount(doc, weights=x, minlength=len(n))
            rows = np.array(rows, dtype=np.int64)
            named = np.array([i is not None for i in ids])
            ids = np.array([i or 0 for i in ids], dtype=np.int64)
            sums = np.stack([rows.view(np.float64), ids.view(np.float64), n, of(known_code[code]), of(log_count[code]), of(lp), named + 2 * np.array(held_out)])
            out = [(int(zlib.crc32(str(rows[0]).encode()) % blocks), b"", b"", b"", b"", b"", b"", sums.tobytes())]
            number: dict[bytes, int] = {}
            words = [np.array([number.setdefault(w, len(number)) for w in r.split()], dtype=np.int64) for r in rare]
            if number:
                d = np.repeat(np.arange(len(words)), [len(w) for w in words])
                pair, times = np.unique(d * len(number) + np.concatenate(words), return_counts=True)
                d, w, spelt = pair // len(number), pair % len(number), list(number)
                block_of = np.array([zlib.crc32(x) % blocks for x in spelt], dtype=np.int64)
                order = np.argsort(block_of[w], kind="stable")
                d, w, times = d[order], w[order], times[order]
                b = block_of[w]
                cuts = np.flatnonzero(np.diff(b)) + 1
                trained_on = np.array(train, dtype=np.uint8)
                for x, y in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(b)]]), strict=True):
                    heads = np.concatenate([[0], np.flatnonzero(np.diff(d[x:y])) + 1])
                    runs = np.diff(np.concatenate([heads, [y - x]])).astype("<u4")
                    own, local = np.unique(w[x:y], return_inverse=True)
                    of_doc = d[x:y][heads]
                    out.append((int(b[x]), rows[of_doc].astype("<i8").tobytes(), trained_on[of_doc].tobytes(), runs.tobytes(), b" ".join([spelt[i] for i in own]), local.astype("<u4").tobytes(), times[x:y].astype("<u4").tobytes(), b""))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

        held, size = [], 0
        for b in batches:
            for row, i, train, held_out, n, codes, rare in zip(*(b.column(c).to_pylist() for c in ("row", "doc_id", "train", "held_out", "n", "codes", "rare")), strict=True):
                held.append((row, i, held_out, train, np.frombuffer(codes, "<u2"), rare))
                size += n
                if size >= FLUSH // 2:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


_PACKED = "bucket int, rows binary, ids binary, flags binary, counts binary, logs binary"
_SUMS = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, log_counts double, log_model double"


def _rare(blocks: int):
    """Of a block of words without vectors: their training counts, and what they add to each row; and
    the rows' own sums. Both packed by bucket of rows, so that there aren't many small rows."""

    def run(table: pa.Table) -> pa.Table:
        docs, parts, number = [], [], {}
        for ids, train, counts, names, words, times, sums in zip(*(table.column(c).to_pylist() for c in ("docs", "train", "counts", "names", "words", "times", "sums")), strict=True):
            if sums:
                x = np.frombuffer(sums, np.float64).reshape(7, -1)
                # flags: named, held out, and that these are a row's own sums
                parts.append((x[0].view(np.int64), x[1].view(np.int64), x[6].astype(np.uint8) | 4, x[2:4].astype(np.int64), x[4:6]))
                continue
            n = np.frombuffer(counts, "<u4")
            wide = np.array([number.setdefault(w, len(number)) for w in names.split(b" ")])
            docs.append((np.repeat(np.frombuffer(ids, "<i8"), n), np.repeat(np.frombuffer(train, np.uint8), n), wide[np.frombuffer(words, "<u4")], np.frombuffer(times, "<u4").astype(np.float64)))
        if docs:
            doc, train, word, times = (np.concatenate(x) for x in zip(*docs, strict=True))
            count = np.bincount(word, weights=times * train, minlength=len(number))
            rows, at = np.unique(doc, return_inverse=True)
            known = np.bincount(at, weights=times * (count[word] > 0)).astype(np.int64)
            logs = np.bincount(at, weights=times * np.log10(count[word] + 0.1))
            parts.append((rows, np.zeros(len(rows), np.int64), np.zeros(len(rows), np.uint8), np.stack([np.zeros(len(rows), np.int64), known]), np.stack([logs, logs])))
        rows, ids, flags = (np.concatenate([p[i] for p in parts]) for i in range(3))
        counts, logs = (np.concatenate([p[i] for p in parts], axis=1) for i in (3, 4))
        bucket = (mix(rows.view(np.uint64)) % np.uint64(blocks)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(blocks + 1))
        out = []
        for b in np.unique(bucket):
            own = order[cuts[b] : cuts[b + 1]]
            out.append((int(b), rows[own].tobytes(), ids[own].tobytes(), flags[own].tobytes(), counts[:, own].tobytes(), logs[:, own].tobytes()))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), *[pa.binary()] * 5), strict=True)], [x.split()[0] for x in _PACKED.split(", ")])

    return run


def _summed(table: pa.Table) -> pa.Table:
    """Of one bucket: the sums of each row."""
    read = lambda c, t: [np.frombuffer(x, t) for x in table.column(c).to_pylist()]
    rows, ids, flags = (np.concatenate(read(c, t)) for c, t in (("rows", "<i8"), ("ids", "<i8"), ("flags", np.uint8)))
    counts = np.concatenate([x.reshape(2, -1) for x in read("counts", "<i8")], axis=1)
    logs = np.concatenate([x.reshape(2, -1) for x in read("logs", "<f8")], axis=1)
    found, at = np.unique(rows, return_inverse=True)
    own = flags >= 4  # one for each row
    doc_id, named, held_out = np.zeros(len(found), np.int64), np.zeros(len(found), bool), np.zeros(len(found), bool)
    doc_id[at[own]], named[at[own]], held_out[at[own]] = ids[own], flags[own] & 1 > 0, flags[own] & 2 > 0
    of = lambda x: np.bincount(at, weights=x, minlength=len(found))
    columns = [pa.array(found), pa.array(doc_id, mask=~named), pa.array(held_out), *[pa.array(of(x).astype(np.int64)) for x in counts], *[pa.array(of(x)) for x in logs]]
    return pa.table(columns, [x.split()[0] for x in _SUMS.split(", ")])


def _top(vocabulary: DataFrame) -> tuple[list[tuple[bytes, int]], DataFrame]:
    """The most frequent words, at most TOP_WORDS of them, and the vocabulary without them. Words
    of about equal frequency share their fate, so only a histogram and the words are collected."""
    level = F.floor(F.log(F.col("n").cast("double")) * LOG_STEPS).cast("int")
    histogram, least, words = vocabulary.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect(), None, 0
    for r in sorted(histogram, key=lambda r: -r.level):
        words += r.words
        if words > TOP_WORDS:
            break
        least = r.level
    if least is None:
        return [], vocabulary
    top = [(bytes(r.word), r.n) for r in vocabulary.where(level >= least).collect()]
    return sorted(top, key=lambda x: (-x[1], x[0])), vocabulary.where(level < least)


def score_documents(documents: DataFrame, folds: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of
    `documents` (doc_id, text).

    The model learns from rows whose crc32(doc_id as text) mod `folds` is not 0, and from those
    without a doc_id, which are never held out. Texts are lower-cased (A-Z) and split at white
    space; each has one end more, counted as a token; null, empty and blank texts have the end
    only. base_score: sum of log10((c + 0.1) / (N + 0.1 * (V + 1))); score: the model's log10
    probability. Rows that repeat a doc_id, or everything, are a document each. With no training rows all counts are
    0. An empty table gives an empty result. Other columns, whatever their names, are ignored.
    Scores don't depend on how rows are dealt to files or tasks, but for rounding.
    """
    spark = documents.sparkSession
    held = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % folds == 0, F.lit(False))
    docs = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), (~held).alias("train"), held.alias("held_out"), "text")
    vocabulary = stored(docs.where("train").select("text").mapInArrow(tidied(_counts), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "lm-vocabulary")
    whole = vocabulary.agg(F.count("*").alias("v"), F.sum("n").alias("n")).first()
    top, others = _top(vocabulary)
    of = F.pmod(F.crc32(F.expr("substring(word, greatest(length(word) - 1, 1), 2)")), F.lit(CLUSTERS))
    tokens, words = np.zeros(CLUSTERS), np.zeros(CLUSTERS)
    for r in others.groupBy(of.cast("int").alias("cluster")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        tokens[r.cluster], words[r.cluster] = r.n, r.v
    ends = docs.where("train").count()
    total, distinct = (whole.n or 0) + ends, whole.v + (ends > 0)
    lexicon = Lexicon(top, ends, tokens, words)
    shared = spark.sparkContext.broadcast(lexicon)  # bounded by TOP_WORDS
    numbered = stored(docs.mapInArrow(tidied(_numbered(shared)), _NUMBERED), "lm-tokens")
    model, parts = lexicon.pack(lexicon.start()), max(1, math.ceil(total / PART_TOKENS))
    # rows that are equal in everything but have no doc_id are told apart by where they stand
    order = F.xxhash64("doc_id", "codes", F.when(F.col("doc_id").isNull(), F.col("row")), F.lit(SEED))
    dealt = numbered.where("train").select(F.pmod(order, F.lit(parts)).alias("part"), order.alias("order"), "codes")
    for wave in (F.col("part") % 3 == 0, F.col("part") % 3 > 0):
        made = dealt.where(wave).groupBy("part").applyInArrow(_train(shared, spark.sparkContext.broadcast(model)), "part long, n long, model binary")
        model = _averaged(made) or model
    blocks = max(16, math.ceil(total / 2 / BLOCK_PAIRS))
    scored = numbered.mapInArrow(tidied(_score(shared, spark.sparkContext.broadcast(model), blocks)), _DEALT)
    packed = scored.groupBy("block").applyInArrow(_rare(blocks), _PACKED)
    out = packed.groupBy("bucket").applyInArrow(_summed, _SUMS)
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("log_counts") - F.col("n_tokens") * math.log10(total + 0.1 * (distinct + 1))).alias("base_score"),
        F.col("log_model").alias("score"),
    )
