"""The operators of the subpackage against brute force, on small and awkward tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from linemetry.llm import bpe, lm_scoring, mixing, ngram_join, quality, queries, url_filter
from linemetry.llm import substring_dedup as substring
from linemetry.llm.collision_ann import approximate_neighbours
from linemetry.llm.exact_topk import exact_top_k
from linemetry.llm.lm_scoring import score_documents
from linemetry.llm.ngram_join import ngram_join as join_ngrams
from linemetry.llm.quality import score_quality
from linemetry.llm.sharding import byte_shards
from linemetry.llm.substring_dedup import substring_dedup

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def letters(i):
    return "".join(chr(97 + i // 26**p % 26) for p in range(4))


def awkward(spark):
    """Nulls, empties, repeats, a long text, near copies and a passage; a clashing extra column."""
    rng = random.Random(7)
    base = [f"w{rng.randrange(4000)}" for _ in range(200)]
    texts = [None, "", " \n\t ", "one", "One", "two words", "a b c", "a b c", " ".join(base), " ".join(base)]
    for _ in range(6):
        near = base[:]
        near[rng.randrange(200)] = "changed"
        texts.append(" ".join(near))
    texts += ["x " * 3000, "y " * 20 + " ".join(base[50:90]), " ".join(f"z{rng.randrange(10**6)}" for _ in range(20000))]
    rows = [(i * 3 + 1, t, "en", None if i % 4 == 0 else f"s{i % 3}", None if t is None else len(t), 1.0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA), rows


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def components_by_force(rows, k, percent):
    sets = {}
    for i, t, *_ in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(t)]
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and sets[a] and sets[b]:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_ngram_join(spark, k, percent, monkeypatch):
    monkeypatch.setattr(ngram_join, "CELL_ROWS", 4)  # clusters of several blocks
    df, rows = awkward(spark)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in join_ngrams(df, k, percent).collect()}
    assert found == components_by_force(rows, k, percent)
    assert join_ngrams(empty(spark), k, percent).count() == 0


def test_ngram_join_in_two_hops(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_GRAMS", 40)
    monkeypatch.setattr(ngram_join, "HOP_BITS", 4)
    monkeypatch.setattr(ngram_join, "FLUSH", 1000)
    df, rows = awkward(spark)
    rows = [r for r in rows if len(words(r[1])) < 10_000]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in join_ngrams(df.where("doc_id < 55"), 3, 90).collect()} == components_by_force(rows, 3, 90)


def test_product_is_exact():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50))) for _ in range(40)]
    n = np.array([len(s) for s in sets])
    got = {(i, j) for a, b in ngram_join.product(sets, n, sets, n, 60) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    assert got == {(i, j) for i in range(40) for j in range(40) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 60 * len(np.union1d(sets[i], sets[j]))}


def test_substring_dedup(spark):
    df, rows = awkward(spark)
    first = {}
    for i, t, *_ in rows:
        w = words(t)
        for j in range(len(w) - 12):
            g = tuple(w[j : j + 13])
            first[g] = min(first.get(g, i), i)
    for r in substring_dedup(df).collect():
        w = words(next(t for i, t, *_ in rows if i == r.doc_id))
        gone = {p for j in range(len(w) - 12) if first[tuple(w[j : j + 13])] < r.doc_id for p in range(j, j + 13)}
        assert (r.n_words, r.n_removed, r.kept) == (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))
        assert sum(s.words for s in r.spans) == len(gone)
    assert substring_dedup(empty(spark)).count() == 0
    whole = {r.doc_id: r.kept for r in substring_dedup(df, joined=False).collect()}
    assert all(whole[i] == (t or "") for i, t, *_ in rows if i <= 25)


def removed_by_force(rows, k):
    first = {}
    for i, t in rows:
        w = words(t)
        for j in range(len(w) - k + 1):
            g = tuple(w[j : j + k])
            first[g] = min(first.get(g, i), i)
    return {i: len({p for j in range(len(words(t)) - k + 1) if first[tuple(words(t)[j : j + k])] < i for p in range(j, j + k)}) for i, t in rows}


def test_substring_dedup_splits_a_hot_prefix(spark, monkeypatch):
    """Every suffix begins with the same four words somewhere; groups stay bounded, in two hops too."""
    rng = random.Random(4)
    rows = [(i, " ".join(f"of the hot line w{rng.randrange(50)}" for _ in range(80))) for i in range(30)]
    rows += [(100 + i, rows[i][1]) for i in range(3)] + [(200, "of the hot line " * 30)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = removed_by_force(rows, 13)
    monkeypatch.setattr(substring, "FLUSH", 2000)
    sizes = []
    for size, at_once in ((1 << 20, 4096), (500, 4096), (200, 20)):
        monkeypatch.setattr(substring, "GROUP_SUFFIXES", size)
        monkeypatch.setattr(substring, "GROUPS", at_once)
        assert {r.doc_id: r.n_removed for r in substring.substring_dedup(df).collect()} == expected
    frequent = [[np.zeros(0, np.uint64)] * 12, None]
    counts = spark.createDataFrame(rows, "doc_id long, text string").mapInArrow(substring._frequent_prefixes(13, 1 / 64), "depth int, prefix long, n long").groupBy("depth", "prefix").sum("n").collect()
    total = next(r[2] for r in counts if r.depth == 0)
    frequent[1] = [np.array([r.prefix for r in counts if r.depth == d and r[2] >= total / 32], dtype=np.int64).view(np.uint64) for d in range(1, 13)]
    for often in frequent:
        dealt = df.mapInArrow(substring._deal(13, 64, 64, often), substring._DEALT).where("kind = 0").select("part", "counts").collect()
        of = Counter()
        for r in dealt:
            of[r.part] += int(np.frombuffer(r.counts, np.uint32).sum())
        sizes.append(max(of.values()))
    assert sizes[1] < sizes[0] / 2 and sizes[1] < total / 10


def test_frequent_prefixes_of_copies(spark, monkeypatch):
    """Copies make no rows of their own, small tasks report no more than the parts need, and the total is what is dealt."""
    rng = random.Random(5)
    copy = " ".join(f"c{i}" for i in range(200))
    rows = [(i, copy) for i in range(400)] + [(400 + i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(200))) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    original, shares = substring._frequent_prefixes, []
    for flush in (1 << 19, 2000):
        monkeypatch.setattr(substring, "FLUSH", flush)
        counts = df.mapInArrow(original(13, 1 / 256), "depth int, prefix long, n long").collect()
        dealt = df.mapInArrow(substring._deal(13, 16, 16, [np.zeros(0, np.uint64)] * 12), substring._DEALT).where("kind = 0").collect()
        assert sum(r.n for r in counts if r.depth == 0) == sum(int(np.frombuffer(r.counts, np.uint32).sum()) for r in dealt)
        if flush > 2000:
            assert len(counts) < 60  # 188 places by 12 depths by 3 tasks before
    monkeypatch.setattr(substring, "_frequent_prefixes", lambda words, share: shares.append(share) or original(words, share))
    assert {r.doc_id: r.n_removed for r in substring.substring_dedup(df.repartition(20)).collect()} == removed_by_force(rows, 13)
    assert shares == [1 / 64]


def test_packed_docs():
    """Ids of any sign and distance come back; those of neighbouring documents take few bytes once compressed."""
    import pyarrow as pa

    for ids in ([], [5], [-(2**63), -7, 0, 2**63 - 1]):
        assert substring.unpack_docs(substring.pack_docs(np.array(ids, dtype=np.int64))).tolist() == ids
    near = np.cumsum(np.random.default_rng(1).integers(1, 40, 5000))
    size = [len(pa.Codec("lz4_raw").compress(x)) for x in (near.tobytes(), substring.pack_docs(near))]
    assert size[1] < size[0] / 2


def test_suffix_order():
    """Neighbours share the words that the depths say: at least those of the level, and fewer than the next."""
    import pyarrow as pa

    from linemetry.llm import _words

    rng = random.Random(3)
    text = [rng.choice("abc") for _ in range(400)]
    w = next(_words.slices(pa.array([" ".join(text)]), lower=False))
    h, code, at = substring.keys(w, 13)
    order, depth = substring.suffix_order(h, code, 13)
    windows = [tuple(text[i : i + 13]) for i in at[order]]
    wrong = 0
    for x, y, d in zip(windows, windows[1:], depth[1:].tolist(), strict=False):
        shared = next((i for i in range(13) if x[i] != y[i]), 13)
        level = max([0, *(v for v in (*substring.levels(13), 13) if v <= shared)])
        assert d >= level and (d == 13) == (shared == 13)
        wrong += d != level  # codes have four bits, so one in sixteen may agree by chance
    assert wrong < 0.2 * len(windows) and len(set(windows)) == (depth < 13).sum()


@pytest.mark.parametrize("name", ["op3_ngram_jaccard_join", "op7_exact_top_k", "op10_substring_dedup"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    found, expected = queries.QUERIES[name](spark, DATA).toPandas(), con.sql(queries.ORACLE[name]).df()
    columns = sorted(found.columns)
    rows = lambda df: sorted(map(tuple, df[columns].astype(str).to_numpy().tolist()))
    assert rows(found) == rows(expected)


@pytest.fixture(scope="module")
def tokenizer():
    with open(queries.vocabulary_path(), encoding="utf-8") as f:
        return bpe.Tokenizer(f.read())


def test_bpe_equals_the_library(spark, tokenizer):
    import tokenizers

    library = tokenizers.Tokenizer.from_file(queries.vocabulary_path())
    df, rows = awkward(spark)
    extra = ["ΑΣ ΣΑΣ İx", "it's WE'RE 12½", "a<|endoftext|>b", "e\u0301 \u00a0x\x1cy", "🎉 日本 한국", "inthaer" * 900]
    rows += [(900 + i, t, None, None, None, None) for i, t in enumerate(extra)]
    out = {r.doc_id: r for r in bpe.encode_documents(spark.createDataFrame(rows, SCHEMA), queries.vocabulary_path(), with_ids=True).collect()}
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert out[i].ids == ids and out[i].n_tokens == len(ids)
        assert out[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert out[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
        plain = "".join(tokenizer.decode(ids))
        assert out[i].text_sha256 == hashlib.sha256(plain.encode()).hexdigest()
    assert "".join(tokenizer.decode(library.encode("naïve 日本").ids)) == "naïve 日本 "
    assert "".join(tokenizer.decode([tokenizer.vocab["ð"], 49407, tokenizer.vocab["a</w>"]])) == "\ufffd<|endoftext|>a "


def own_ids(tokenizer, text):
    ids = []
    tokenizer.pieces(text.encode(), ids.extend)
    return ids


def test_bpe_streams_real_documents(spark, tokenizer):
    """Every document of sf0.01 as the library encodes it; tokens leave before their word is read,
    and few symbols are held."""
    import tokenizers

    library = tokenizers.Tokenizer.from_file(queries.vocabulary_path())
    tokenizer.merger.early = tokenizer.merger.most_held = 0
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    for text, whole in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert own_ids(tokenizer, text) == whole.ids
    assert tokenizer.merger.early > 10_000 and tokenizer.merger.most_held <= 32 < tokenizer.merger.lookahead


def test_bpe_random_strings(tokenizer):
    import tokenizers

    library, rng = tokenizers.Tokenizer.from_file(queries.vocabulary_path()), random.Random(9)
    points = [lambda: rng.randrange(0x110000), lambda: rng.randrange(0x3000), lambda: rng.randrange(128), lambda: rng.randrange(0x1C00, 0x1D00), lambda: rng.randrange(0x10000, 0x17000)]
    for _ in range(2000):
        text = "".join(chr(c) for c in (rng.choice(points)() for _ in range(20)) if not 0xD800 <= c < 0xE000)
        assert own_ids(tokenizer, text) == library.encode(text, add_special_tokens=False).ids
    for text in ("".join(rng.choice("inthaersoxq'") for _ in range(5000)), "inthaer" * 9000, "a" * 400_000, "x1!" * 100_000):
        assert own_ids(tokenizer, text) == library.encode(text, add_special_tokens=False).ids


def test_bpe_pieces_change_nothing(tokenizer, monkeypatch):
    rng = random.Random(2)
    text = " ".join("".join(rng.choice("inthaersoé") for _ in range(rng.choice([3, 9, 200]))) for _ in range(300))
    whole = own_ids(tokenizer, text)
    monkeypatch.setattr(bpe, "PIECE_BYTES", 50)
    monkeypatch.setattr(bpe, "PIECE_IDS", 3)
    held = []
    tokenizer.pieces(text.encode(), held.append)
    assert [i for ids in held for i in ids] == whole and len(held) > 100
    machine = bpe.Decoder(tokenizer)
    assert b"".join(machine.plain([i]) for i in whole) + machine.rest() == bpe.Decoder(tokenizer).plain(whole)


def test_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 16)]) for i in range(400)]
    rows += [(400 + i, rows[20][1]) for i in range(30)] + [(500, None), (501, []), (502, [0.0] * 16), (503, [math.nan] + [1.0] * 15), (504, [None] + [1.0] * 15), (505, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = df.where("vec_id % 20 = 0")
    good = {i: np.array(v, dtype=np.float32).astype(float) for i, v in rows if v and len(v) == 16 and all(x is not None and math.isfinite(x) for x in v)}
    top = exact_top_k(df, asked, 5).collect()
    for q in (i for i in good if i % 20 == 0):
        scores = sorted(((-int(np.floor(64 * good[q]) @ np.floor(64 * v)), i) for i, v in good.items() if i != q))[:5]
        assert [(-r.score, r.vec_id) for r in sorted((r for r in top if r.query_id == q), key=lambda r: r.rank)] == scores
    good.pop(502)
    near, hits, total = approximate_neighbours(df, asked, 5).collect(), 0, 0
    for q in (i for i in good if i % 20 == 0):
        exact = [i for _, i in sorted((np.sqrt(((good[q] - v) ** 2).sum()), i) for i, v in good.items() if i != q)[:5]]
        mine = [r for r in near if r.query_id == q]
        assert len(mine) == 5 and all(abs(r.score - np.sqrt(((good[q] - good[r.vec_id]) ** 2).sum())) < 1e-12 for r in mine)
        hits, total = hits + len(set(exact) & {r.vec_id for r in mine}), total + 5
    assert hits >= 0.9 * total
    assert approximate_neighbours(df.limit(0), asked.limit(0), 5).count() == 0


def test_vectors_with_repeated_ids_and_clashing_names(spark):
    rows = [(i % 30, [float(i % 7), float(i), 1.0], i, i) for i in range(40)]  # ids 0..9 twice
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, number long, query_id long").withColumn("rank", F.lit(1)).withColumn("dim", F.lit(1)).withColumn("value", F.lit(1)).withColumn("row_block", F.lit(1))
    asked = df.where("vec_id = 0")
    near = sorted((r.score, r.vec_id, r.rank) for r in approximate_neighbours(df, asked, 4).collect())
    top = sorted((-r.score, r.vec_id, r.rank) for r in exact_top_k(df, asked, 4, 1).collect())
    expected_near, expected_top = [], []
    for q in (rows[0], rows[30]):
        a, others = np.array(q[1]), [r for r in rows if r[0] != 0]
        expected_near += [(d, i, n) for n, (d, i) in enumerate(sorted((float(np.sqrt(((a - np.array(v)) ** 2).sum())), i) for i, v, *_ in others)[:4], 1)]
        expected_top += [(s, i, n) for n, (s, i) in enumerate(sorted((-int(a @ np.array(v)), i) for i, v, *_ in others)[:4], 1)]
    assert top == sorted(expected_top)
    assert len(near) == 8 and sorted(n for *_, n in near) == [1, 1, 2, 2, 3, 3, 4, 4]
    assert all(abs(a[0] - b[0]) < 1e-9 for a, b in zip(near, sorted(expected_near), strict=True))


def test_collision_counting_verifies_few(spark):
    """On the real table: recall of at least 0.9, with fewer than a tenth of the candidates verified."""
    from linemetry.llm import collision_ann

    found = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").toPandas()
    rows, ids = np.stack(found.embedding).astype(float), found.vec_id.to_numpy()
    index, hits, asked = collision_ann.Index(ids, rows, collision_ann.DIRECTIONS, collision_ann.SEED), 0, np.flatnonzero(ids % 100 == 0)
    for i in asked:
        distance = np.sqrt(((rows - rows[i]) ** 2).sum(axis=1))
        distance[i] = np.inf
        near, scores = index.search(ids[i], rows[i], 10)
        hits += len(set(near) & set(ids[np.lexsort((ids, distance))[:10]]))
        assert np.allclose(scores, distance[np.searchsorted(ids, near)], rtol=0, atol=1e-12)
    assert hits >= 0.9 * 10 * len(asked) and index.verified < 0.1 * len(asked) * len(ids)


def test_shards(spark):
    df, rows = awkward(spark)
    out = {r.doc_id: r for r in byte_shards(df, 4).collect()}
    size = {i: len((t or "").encode()) + 8 for i, t, *_ in rows}
    total, before, slots = sum(size.values()), 0, Counter()
    for i, t, *_ in sorted(rows):
        shard = min(3, (2 * before + size[i]) * 4 // (2 * total))
        assert (out[i].size, out[i].shard, out[i].slot, out[i].text_crc32, out[i].law) == (size[i], shard, slots[shard], zlib.crc32((t or "").encode()), "bytes")
        before, slots[shard] = before + size[i], slots[shard] + 1
    assert byte_shards(empty(spark), 4).count() == 0


def test_mix(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    out = mixing.mix(df).toPandas()
    assert (out.taken <= 2 * out["size"]).all() and (out.taken >= 0).all()
    for _, g in out.groupby("source"):
        assert g.source_size.iloc[0] == g["size"].sum() and abs(g.taken.sum() - g.target.iloc[0]) <= 0.02 * g.target.iloc[0]
    assert abs(out.groupby("source").target.first().sum() / out["size"].sum() - 1.5) < 1e-9
    again = mixing.mix(df).toPandas().set_index("doc_id").taken
    assert again.sort_index().equals(out.set_index("doc_id").taken.sort_index())
    parts = mixing.mixed_documents(df).toPandas()
    assert sum(len(words(t)) for t in parts.text) == out.taken.sum()
    odd, rows = awkward(spark)
    assert mixing.mix(odd).count() == len(rows) and mixing.mix(empty(spark)).count() == 0


def test_mix_of_small_sources(spark):
    rows = [(i, "w " * 20_000, "large") for i in range(200)] + [(900, "a b c", "small"), (901, "d", "small"), (902, "e f", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = {r.doc_id: r.taken for r in mixing.mix(df).collect()}
    assert [taken[i] for i in (900, 901, 902)] == [6, 2, 4]
    assert abs(sum(taken[i] for i in range(200)) - 6_000_000) < 3000
    assert sorted(r.text for r in mixing.mixed_documents(df).where("doc_id >= 900").collect()) == ["a b c", "a b c", "d", "d", "e f", "e f"]
    target = {"a": 5e9, "b": 3e9, "c": 356_000.0, "d": 3.0, "e": 0.0}
    of = {s: block for block, own in mixing.levels(target, list(target)) for s in own}
    assert set(of) == set(target) and all(64 * of[s] <= target[s] or of[s] == 1 for s in "abcd")


def test_mix_replayed(spark):
    """taken, quotas and texts against a replay of the picked blocks, word by word."""
    rng = random.Random(6)
    rows = [(i, " ".join(f"w{i}_{j}" for j in range(rng.choice([1, 3, 40, 300]))), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(150)]
    rows += [(7, rows[7][1], rows[7][2])] * 2 + [(None, "no id here", "a"), (500, None, "b"), (501, " ", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("start", F.lit(1)).withColumn("size", F.lit("x")).withColumn("h", F.lit(2)).withColumn("picks", F.lit(3)).withColumn("row", F.lit(4))
    chosen, placed = mixing._mixed(df, (5, 2, 1), 1.5, 2.0, 1)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    plan = {r.source: r for r in mixing.plan(spark, sizes, (5, 2, 1), 1.5, 2.0).collect()}
    picked = {}
    for r in chosen.collect():
        for p in (0, 1):
            if r[f"picked_{p}"]:
                picked[r.source, p, r.block] = r[f"shard_{p}"]
    for s, r in plan.items():  # each shard has its quota of blocks
        quotas = np.diff([0, *r.quotas])
        have = Counter(shard for (source, *_), shard in picked.items() if source == s)
        assert all(have[j] <= quotas[j] for j in range(mixing.SHARDS - 1)) and abs(sum(have.values()) - quotas.sum()) <= 1
        assert all(have[j] == quotas[j] for j in range(max(have)))
    lines = {s: [] for s in plan}
    expected = []
    for r in sorted(placed.collect(), key=lambda r: r.start):
        n = sum((r.source, p, x // r.block_words) in picked for x in range(r.start, r.start + r.size) for p in (0, 1))
        assert r.taken == n and len(lines[r.source]) == r.start
        lines[r.source] += [r.doc_id] * r.size
        expected.append(n)
    assert all(len(lines[s]) == sizes[s] for s in plan)
    parts = mixing.mixed_documents(df, seed=1, by_shard=True).collect()
    assert sum(len(words(r.text)) for r in parts) == sum(expected)
    of_shard, blocks = Counter(), Counter()
    for r in parts:
        of_shard[r.source, r.shard] += len(words(r.text))
    for (s, _, block), shard in picked.items():
        blocks[s, shard] += min(plan[s].block_words, sizes[s] - block * plan[s].block_words)
    assert of_shard == blocks and {r.size for r in parts} == {"x"} and {r.picks for r in parts} == {3}
    whole = mixing.mixed_documents(df, seed=1).collect()
    assert sorted(w for r in whole for w in words(r.text)) == sorted(w for r in parts for w in words(r.text))
    assert mixing.mixed_documents(df.limit(0)).count() == 0


def test_apportionment():
    assert mixing.sainte_lague([53, 24, 23], 7) == [3, 2, 2]
    quotas = mixing.shard_quotas([5, 2, 1], 100, 7)
    assert all(q >= 0 for s in quotas for q in s) and [sum(x) for x in zip(*quotas, strict=True)] == mixing.sainte_lague([5, 2, 1], 100)


def test_urls(spark):
    urls = ["http://a.org/x", "http://a.org", "https://EXAMPLE.org/es/1", "http://x.example.org/en/12?q", "http://u.com/de/", "http://u.com/fr/", "http://m.casinowin.net/p", "http://fine.net/p", None, "nothing", "http://h.net?x://y"] + ["http://casino-win.net/a", "http://good.net/a"] * 5
    out = [(r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).orderBy("page_id").collect()]
    assert out[:11] == [
        ("a.org", "/x", "org/", "allow"), ("a.org", "", None, "allow"), ("example.org", "/es/1", "example.org/es/", "block"), ("x.example.org", "/en/12", "example.org/en/1", "block"), ("u.com", "/de/", "com/de/", "block"), ("u.com", "/fr/", "com/fr/", "allow"),
        ("m.casinowin.net", "/p", None, "block"), ("fine.net", "/p", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("h.net", "", None, "allow"),
    ]
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_split_against_all_splits():
    rng = random.Random(8)
    for _ in range(200):
        counts = {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 5))): rng.randrange(1, 50) for _ in range(8)}
        name, total = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 10))), 1 + sum(counts.values())

        def value(parts, counts=counts, total=total):
            return sum(math.log(counts[w] / total) if w in counts else math.log(1 / total) - 3.0 * len(w) for w in parts)

        every = []
        for cuts in range(1 << (len(name) - 1)):
            at = [0, *(i + 1 for i in range(len(name) - 1) if cuts >> i & 1), len(name)]
            every.append([name[x:y] for x, y in zip(at, at[1:], strict=False)])
        assert abs(value(url_filter.split(name, counts, total)) - max(map(value, every))) < 1e-9


def test_urls_awkward(spark):
    urls = [None, "", "://", "http://a.net/x", "http://a.net/x", "http://" + "b" * 5000 + ".net/" + "c" * 5000, "http://é.net/ü"]
    rows = [(None if i == 4 else 1, u, "h", 1, "w", 2) for i, u in enumerate(urls)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, id int, words string, bad int").withColumn("path", F.lit(1)).withColumn("n", F.lit(1))
    out = url_filter.filter_urls(df).collect()
    assert len(out) == len(urls) and sum(r.page_id is None for r in out) == 1 and all(r.verdict == "allow" for r in out)
    assert sorted(r.host for r in out)[:3] == ["", "", ""] and ("é.net", "/ü") in {(r.host, r.path) for r in out}


def test_urls_learn_from_labels(spark):
    rows = [(i, f"http://{'quiet' if i % 2 else 'noisy'}.net/p{i}") for i in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 2 == 0) for i in range(12)] + [(3, None), (None, True)], "page_id long, unwanted boolean")
    out = url_filter.filter_urls(df, labels=labels).collect()
    assert {r.page_id for r in out if r.verdict == "block"} == {i for i in range(20) if i % 2 == 0}


def test_urls_words_of_paths(spark):
    urls = ["http://casinovelvet.net/p"] * 3 + ["http://fine.net/velvet/p"] * 6
    out = url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    assert all(r.tokens[:2] == ["casino", "velvet"] and r.verdict == "block" for r in out if r.page_id < 3)
    assert all(r.verdict == "allow" for r in out if r.page_id >= 3)


def test_urls_keep_all_words(spark):
    # 60,000 path words occur twice, so these, which occur once, are past the 50,000 most frequent
    often = [f"http://fine.net/{'/'.join(f'{letters(i)}k' for i in range(x, x + 500))}" for x in range(0, 60_000, 500)] * 2
    rows = [f"http://casino.net/{letters(i)}z" for i in range(50)] + [f"http://quiet.net/{'/'.join(f'{letters(i)}z' for i in range(50))}"]
    df = spark.createDataFrame(list(enumerate(rows + often)), "page_id long, url string")
    out = {r.page_id: r for r in url_filter.filter_urls(df).where("page_id <= 50").collect()}
    of = Counter(), Counter()
    for x in url_filter.filter_urls(df).select("host", "tokens").collect():
        of[x.host == "casino.net"].update(x.tokens)
    v = len(of[0] | of[1])
    good, bad = sum(of[0].values()) + v + 1, sum(of[1].values()) + v + 1
    start = math.log(51 / (len(often) + 2))
    for r in out.values():
        assert abs(r.log_odds - start - sum(math.log((of[1][t] + 1) / bad) - math.log((of[0][t] + 1) / good) for t in r.tokens)) < 1e-6
    assert out[50].log_odds > 0 and out[50].verdict == "block"


def test_language_model(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = score_documents(df).toPandas()
    tokens = {i: [x.lower() for x in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())] + [None] for i, t in df.select("doc_id", "text").collect()}
    count = Counter(w for i, v in tokens.items() if zlib.crc32(str(i).encode()) % 10 for w in v)
    n, v = sum(count.values()), len(count)
    for r in out.itertuples():
        own = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(count[w] > 0 for w in own), n)
        assert abs(r.base_score - sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)) < 1e-6 * abs(r.base_score)
    assert (out.score < 0).all()
    # an unknown word has a slot for itself in its cluster, so documents of known words are compared
    held = out[out.held_out & (out.n_known == out.n_tokens)]
    assert len(held) >= 10 and held.score.sum() > held.base_score.sum() and (held.score > held.base_score).mean() > 0.8
    again = score_documents(df.repartition(5)).toPandas().set_index("doc_id").score
    assert np.allclose(again, out.set_index("doc_id").score.loc[again.index], rtol=1e-3)
    odd, rows = awkward(spark)
    assert score_documents(odd).count() == len(rows) and score_documents(empty(spark)).count() == 0


def test_language_model_adds_up_to_one():
    """After any context the probabilities of all classes, words, rests and unknown words add up to 1."""
    rng, words = np.random.default_rng(1), random.Random(1)
    top = [(bytes(words.choice(b"abcdefgh") for _ in range(4)) + b"%d" % i, 1000 - i) for i in range(900)]
    lex = lm_scoring.Lexicon(top, 50, rng.integers(0, 9, lm_scoring.CLUSTERS).astype(float), rng.integers(0, 5, lm_scoring.CLUSTERS).astype(float))
    model = lex.start()
    trainer = lm_scoring.Trainer(lex, model, 1)
    for _ in range(20):
        trainer.step(*(rng.integers(0, lex.begin, 500).astype(np.int32) for _ in range(3)))
    code = np.arange(lex.begin, dtype=np.int32)
    for one, two in ((lex.begin, lex.begin), (3, 700), (899, lex.end)):
        lp = lm_scoring.log10_probabilities(lex, model, code, np.full(len(code), one, np.int32), np.full(len(code), two, np.int32))
        assert abs((10**lp).sum() - 1) < 1e-4
    # by hand: one token's class, then the word among its cluster's
    h = model["r1"][3] + model["r2"][700]
    for c in (5, 600, lex.first_rest + 9):
        own = lex.class_of[c]
        p = np.exp(model["q"] @ h + model["b"])
        p = p[own] / p.sum()
        if lex.inner[c] >= 0:
            members = [x for x in code if lex.class_of[x] == own]
            w = {x: np.exp(model["qi"][lex.inner[x]] @ h + model["bi"][lex.inner[x]]) for x in members}
            p *= w[c] / sum(w.values())
        lp = lm_scoring.log10_probabilities(lex, model, np.array([c], np.int32), np.array([3], np.int32), np.array([700], np.int32))
        assert abs(lp[0] - math.log10(p)) < 1e-4
    # the words of a rest, and one slot for all unknown ones
    tokens, distinct = 12.0, 3
    shares = [(n + 0.1) / (tokens + 0.1 * (distinct + 1)) for n in (6, 5, 1)] + [0.1 / (tokens + 0.1 * (distinct + 1))]
    assert abs(sum(shares) - 1) < 1e-12


def test_language_model_keeps_all_rows(spark):
    rows = [(None, "a b rare"), (None, "a b"), (0, "a zero"), (1, "b rare"), (1, "b rare"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("train", F.lit(1)).withColumn("codes", F.lit(1))
    out = score_documents(df).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens) for r in out) == [(-1, 1), (-1, 3), (-1, 4), (0, 3), (1, 3), (1, 3)]
    held = {i for i in (0, 1) if zlib.crc32(str(i).encode()) % 10 == 0}
    assert {r.doc_id for r in out if r.held_out} == held
    assert all(r.train_tokens == 8 + 3 * (0 not in held) + 6 * (1 not in held) for r in out)
    assert all(r.n_known == r.n_tokens and r.score < 0 for r in out if r.doc_id is None)


def test_most_frequent_words(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "TOP_WORDS", 3)
    top, others = lm_scoring._top(spark.createDataFrame([(b"a", 1000), (b"b", 100), (b"c", 10), (b"d", 10)], "word binary, n long"))
    assert top == [(b"a", 1000), (b"b", 100)] and sorted(bytes(r.word) for r in others.collect()) == [b"c", b"d"]


def test_quality(spark):
    out = queries.op8_quality_classifier(spark, "/root/testdata/sf0.1").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas().merge(out, on="doc_id")
    held = labels[labels.held_out]
    assert len(out) == 10000 and out.score.between(0, 1).all()
    assert (held.predicted == held.quality).mean() > 0.97 and (held[held.quality == 1].predicted == 1).mean() > 0.99
    odd, rows = awkward(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert score_quality(odd, none).count() == len(rows) and score_quality(empty(spark), none).count() == 0


def test_factorisation_machine_equals_pairs(spark):
    """The linear-time margin is the sum over all pairs of features."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    texts = pa.array(["one two three", "", "Two  two! X\n#$ 12 ünï", "a " * 50])
    n = quality.BUCKETS + len(quality.STATISTICS)
    machine = quality.Machine(0.3, rng.normal(size=n), rng.normal(size=(n, quality.DIMENSIONS)), rng.normal(size=len(quality.STATISTICS)), np.ones(len(quality.STATISTICS)))
    f = next(quality.features(texts, np.array([13.0, 0, 23, 100])))
    doc, feature, value = machine.terms(f)
    margin, _ = machine.margin(doc, feature, value, 4)
    for d in range(4):
        own, x = feature[doc == d], value[doc == d]
        pairs = sum(machine.factor[a] @ machine.factor[b] * x[i] * x[j] for i, a in enumerate(own) for j, b in enumerate(own) if i < j)
        assert abs(margin[d] - (0.3 + machine.weight[own] @ x + pairs)) < 1e-9


def test_quality_keeps_columns(spark):
    odd, rows = awkward(spark)
    labels = spark.createDataFrame([(r[0], i % 2, 0) for i, r in enumerate(rows)] + [(None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    out = score_quality(odd.withColumn("label", F.lit(7)).withColumn("buckets", F.lit("b")), labels, sample_rows=9)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "label", "buckets", "held_out", "score", "predicted"]
    assert {(r.label, r.buckets) for r in out.collect()} == {(7, "b")} and out.count() == len(rows)


def test_stages_on_awkward_tables(spark):
    """Every stage on nulls, empties, repeats, long texts, ties, clashing names and empty tables."""
    import corpus_pipeline

    odd, rows = awkward(spark)
    odd = odd.unionByName(odd.limit(3)).unionByName(odd.where("doc_id = 28").withColumn("doc_id", F.lit(None).cast("long")))
    for name in ("size", "start", "h", "places", "changed", "copy", "of_id", "mix_h", "places_of", "row", "label", "picks", "n", "gram", "component_id"):
        odd = odd.withColumn(name, F.lit(name))
    seen = odd.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, DATA)
        kept = out.collect()
        assert name in ("source_mix", "tokens") or len(kept) <= seen
        if name != "tokens":
            assert out.columns == odd.columns and all(r.places == "places" and r.size == "size" for r in kept)
        else:
            assert len(kept) == seen
        if name == "repeated_passages":
            assert len(kept) == seen and sum(r.doc_id is None for r in kept) == 1
        assert stage(spark, odd.limit(0), DATA).count() == 0


def test_stored_tables_leave_no_shuffle_files(spark):
    import time

    from linemetry.llm import _tables

    def shuffles():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return {x for x in blocks.getAllFiles().mkString("\n").split("\n") if "shuffle_" in x}

    before, setting = shuffles(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    df = _tables.stored(spark.range(1000).repartition(3, "id").groupBy(F.col("id") % 7).count(), "sevenths")
    until = time.time() + 20
    while shuffles() - before and time.time() < until:  # they go in the background
        time.sleep(0.1)
    assert not shuffles() - before and df.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting


def test_stored_tables_can_be_dropped(spark):
    import os

    from linemetry.llm import _tables

    df = _tables.stored(spark.range(3).toDF("x"), "test")
    where = df.inputFiles()[0].removeprefix("file:")
    where = where[where.rindex("//") + 1 :] if "//" in where else where
    assert os.path.exists(where) and _tables.drop_stored(spark) > 0 and not os.path.exists(where) and _tables.drop_stored(spark) == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs, kept = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append(docs)
    assert all(d.columns == ["doc_id", "text", "lang", "source", "n_chars"] for d in kept[:4])
    before, after = ([(r.doc_id, r.text) for r in d.collect()] for d in kept[:2])
    group = components_by_force(before, 5, 80)
    assert sorted(i for i, _ in after) == sorted(i for i, (_, c) in group.items() if i == c)
    cut = {i: len(words(t)) for i, t in ((r.doc_id, r.text) for r in kept[2].collect())}
    removed = removed_by_force(after, 50)
    assert cut == {i: len(words(t)) - removed[i] for i, t in after}
    taken = {r.doc_id: r.taken for r in mixing.mix(kept[2]).collect()}
    mixed = Counter()
    for r in kept[3].collect():
        mixed[r.doc_id] += len(words(r.text))
    assert mixed == Counter({i: n for i, n in taken.items() if n})
    import tokenizers

    library = tokenizers.Tokenizer.from_file(queries.vocabulary_path())
    expected = sorted((r.doc_id, library.encode(r.text, add_special_tokens=False).ids) for r in kept[3].collect())
    assert sorted((r.doc_id, r.ids) for r in kept[4].collect()) == expected

