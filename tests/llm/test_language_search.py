"""Language identification, collocations and ranked search against brute force, on small and awkward tables."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from linemetry.llm import collocations as col
from linemetry.llm import language_id as lid
from linemetry.llm import lexical_search as lex
from linemetry.llm import queries
from linemetry.llm._runs import kinds, runs

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, rank int, score string"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def awkward(spark):
    """Nulls, empties, marks, repeats, ties, a long text; columns with clashing names."""
    rng = random.Random(3)
    texts = [None, "", " \n\t ", "?!...", "one", "One", "one, one. one", "a b\tc d", "a b c d", "été ÉTÉ über", "日本 語 日本", "12 x1 x1"]
    texts += [" ".join(rng.choice(["red", "sea", "big", "dog", "Red", "sea."]) for _ in range(n)) for n in (5, 50, 400, 3000)]
    rows = [(i * 5 + 1, t, [None, "en", "und", "fr"][i % 4], None, 1, "x") for i, t in enumerate(texts)] + [(6, "one", "en", "s", 2, "y"), (None, "red sea dog", "en", "s", 2, "y")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3), rows


def test_runs():
    texts = ["Ab  c.d", None, "é,\tF", ""]
    found = list(runs(pa.array(texts), kinds(b" \t", b".,"), 5))
    assert [(r.first, r.stop) for r in found] == [(0, 1), (1, 4)]
    assert [r.words.to_pylist() for r in found] == [["ab", "c", "d"], ["é", "f"]]
    assert [r.piece.tolist() for r in found][0] == [0, 0, 1] and found[1].doc.tolist() == [1, 1]


# ranked search


def ranked_by_force(docs, items, k):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered(t))
    held = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n, length = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c, size in held:
            m = 25 + 75 * size * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if score:
                scores.append((-score, d is None, d or 0))
        out += [(item, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("docs_of_a_shard, block, query_bytes", [(16384, 1024, 4 << 20), (4, 2, 40)])
def test_ranked_search(spark, monkeypatch, docs_of_a_shard, block, query_bytes):
    monkeypatch.setattr(lex, "SHARD_DOCS", docs_of_a_shard)
    monkeypatch.setattr(lex, "BLOCK", block)
    monkeypatch.setattr(lex, "QUERY_BYTES", query_bytes)
    docs, rows = awkward(spark)
    items = [(1, "Red sea"), (2, "one one dog"), (3, None), (4, "..."), (5, "nowhere"), (6, "été 日本 語 x1 big"), (None, "sea dog big red one a b c")]
    found = lex.lexical_search(docs, spark.createDataFrame(items, "item_id long, text string"), k=3)
    assert sorted((tuple(r) for r in found.collect()), key=str) == ranked_by_force([r[:2] for r in rows], items, 3)


def test_ranked_search_of_nothing(spark):
    docs, _ = awkward(spark)
    none = spark.createDataFrame([], "item_id long, text string, doc_id string")
    assert lex.lexical_search(docs, none).count() == 0
    items = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert lex.lexical_search(docs.where("false"), items).count() == 0
    assert lex.lexical_search(docs.where("text is null"), items).count() == 0


def test_max_score_reads_few_postings():
    """Shards of many documents: the k best are exact, and most postings of frequent terms aren't read."""
    rng = np.random.default_rng(5)
    n = 8192
    texts = [" ".join(f"t{i}" for i in rng.zipf(1.3, 60) if i < 3000) for _ in range(n)]
    asked = [(i, " ".join(f"t{j}" for j in [1, 2, 3, 4, *rng.integers(40, 600, 2)])) for i in range(20)]
    q = lex.parsed(asked)
    df, sizes = Counter(), []
    split = [t.split() for t in texts]
    for t in split:
        df.update(set(t))
        sizes.append(len(t))
    q.docs, q.length = sum(s > 0 for s in sizes), sum(sizes)
    q.weights = np.array([math.floor(1000 * math.log((2 * q.docs + 2) / (2 * df[t] + 1))) for t in q.terms.to_pylist()])
    shard = lex.Shard(q)
    for r in runs(pa.array(texts), lex._KIND, 1 << 20):
        shard.add(pa.array(range(r.first, r.stop)), lex._known(q, r.words), r.doc, r.size)
    shard.build()
    read = whole = 0
    expected = defaultdict(list)
    for item, rank, d, s in ranked_by_force(list(enumerate(texts)), asked, 10):
        expected[item].append((rank, d, s))
    for i in range(len(asked)):
        places, scores, seen = shard.best(i, 10)
        assert [(r + 1, d, s) for r, (d, s) in enumerate(zip(places.tolist(), scores.tolist(), strict=True))] == sorted(expected[i])
        read += seen
        whole += sum(shard.edges[t, -1] - shard.edges[t, 0] for t in q.asked[i][0])
    assert read < 0.5 * whole


def test_norms_beyond_64_bits():
    q = lex.parsed([(1, "a")])
    q.docs, q.length, q.weights = 10**18, 10**18, np.array([5])
    shard = lex.Shard(q)
    shard.add(pa.array([7]), np.zeros(3, np.int64), np.zeros(3, np.int64), 1)
    shard.build()
    assert shard.adds.tolist() == [5 * (3 * 10**9 // (3000 + 8 * (25 + 225)))]


# collocations


def collocations_by_force(rows, least, top, most_words=4):
    counts, words = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            counts[lang].update(tuple(w[i : i + k]) for k in range(1, most_words + 1) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        found = []
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        for p, a in candidates.items():
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            if not any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in candidates.items()):
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, le, r, words[lang], -s) for i, (s, a, p, le, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.mark.parametrize("bits, held, slice_bytes", [(24, 1 << 19, 4 << 20), (6, 50, 200)])
def test_collocations(spark, monkeypatch, bits, held, slice_bytes):
    monkeypatch.setattr(col, "HELD", held)
    monkeypatch.setattr(col, "SLICE_BYTES", slice_bytes)
    docs, rows = awkward(spark)
    for least, top in ((2, 2000), (9, 3), (300, 10)):
        found = sorted(tuple(r) for r in col.collocations(docs, least=least, top=top, bits=bits).collect())
        assert found == collocations_by_force(rows, least, top) and (found or least == 300)


def test_collocations_prune(spark):
    """Buckets and parts let few phrases through that aren't frequent."""
    rng = random.Random(1)
    texts = [(" ".join(f"w{int(rng.paretovariate(0.6))}" for _ in range(400)), "en") for _ in range(50)]
    docs = spark.createDataFrame(texts, "text string, lang string").coalesce(1)
    first = docs.mapInArrow(col._pass(1, 4, 5, 16, None, None), col.SCHEMA).cache()
    frequent = first.where("phrase is not null").groupBy("lang", "phrase").sum("amount").where("`sum(amount)` >= 5").select("lang", "phrase")
    parts = col._bitmap(frequent.mapInArrow(col._marks(1, 16, 5), col.SCHEMA), 16, 5)
    pairs = docs.mapInArrow(col._pass(2, 4, 5, 16, parts, col._bitmap(first, 16, 5)), col.SCHEMA).where("phrase is not null")
    counts = Counter(p for t, _ in texts for p in zip(t.split(), t.split()[1:], strict=False))
    assert {tuple(r.phrase.split()) for r in pairs.collect() if r.amount >= 5} == {p for p, n in counts.items() if n >= 5}
    assert pairs.count() < 0.2 * len(counts)
    first.unpersist()


def test_collocations_of_nothing(spark):
    docs, _ = awkward(spark)
    assert col.collocations(docs.where("false")).count() == 0
    assert col.collocations(docs.where("text is null")).count() == 0


def test_scores_beyond_64_bits(spark):
    schema = "lang string, phrase string, f long"
    big = 4 * 10**18
    tables = [spark.createDataFrame(x, schema) for x in ([("en", "a", big), ("en", "b", big + 7)], [("en", "a b", big - 1)])]
    (row,) = col._ranked(tables, spark.createDataFrame([("en", 2 * big)], "lang string, n long"), 10, 80).collect()
    assert (row.score, row.l, row.r) == (2000000 * (big - 1) // (2 * big + 7), big, big + 7)


# language identification


def grams_by_force(text):
    found, word = Counter(), []
    for c in text.lower() + " ":
        if lid.unicodedata.category(c)[0] in "LM":
            word.append(c)
        elif word:
            padded = ["_", *word, "_"]
            found.update(word)
            found.update(zip(padded, padded[1:], strict=False))
            found.update(zip(padded, padded[1:], padded[2:], strict=False))
            word = []
    return found


def named(gram):
    symbols = [gram >> 42, gram >> 21 & (1 << 21) - 1, gram & (1 << 21) - 1]
    out = tuple("_" if s == 1 else chr(s - 2) for s in symbols if s)
    return out[0] if len(out) == 1 else out


def test_grams(monkeypatch):
    texts = ["", "Ab a", "été-ÉTÉ 12x", "éa ́", "日本 語" * 30, "abc " * 100, "?"]
    for part in (1 << 20, 50):
        monkeypatch.setattr(lid, "PART", part)
        found, has = defaultdict(Counter), []
        for first, stop, (text, gram, count), own in lid.counted(texts):
            has += own.tolist()
            for t, g, c in zip(text.tolist(), gram.tolist(), count.tolist(), strict=True):
                found[first + t][named(g)] += c
        assert [found[i] for i in range(len(texts))] == [grams_by_force(t) for t in texts]
        assert has == [any(c.isalpha() for c in t) for t in texts]


def test_distances():
    """Out-of-place distances against their definition."""
    rng = random.Random(2)
    texts = ["".join(rng.choice("abc d") for _ in range(60)) for _ in range(12)]
    text, gram, rank = lid.ranks(lid.grams(texts)[0], 20)
    rows = [(f"l{t % 3}", g, r) for t, g, r in zip(text.tolist(), gram.tolist(), rank.tolist(), strict=True) if t < 3]
    profiles = lid.Profiles.of(rows, 20)
    near = profiles.nearness((text, gram, rank), len(texts))
    for i in range(len(texts)):
        own = dict(zip(gram[text == i].tolist(), rank[text == i].tolist(), strict=True))
        for j, name in enumerate(profiles.names):
            of = {g: r for lang, g, r in rows if lang == name}
            assert 20 * len(own) - near[i, j] == sum(abs(of[g] - r) if g in of else 20 for g, r in own.items())


def test_languages(spark):
    docs, rows = awkward(spark)
    out = lid.identify_languages(docs)
    assert out.columns == [*[c for c in docs.columns if c != "score"], "held_out", "lang_pred", "score"]
    found = out.collect()
    assert len(found) == len(rows)
    learned = {r[2] for r in rows if r[2] and r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5}
    for r in found:
        letters = any(c.isalpha() for c in r.text or "")
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.lang_pred in learned if letters else (r.lang_pred == "und" and r.score == 0)
        assert 0 <= r.score <= 1
    assert lid.identify_languages(docs.where("false")).count() == 0
    assert {r.lang_pred for r in lid.identify_languages(docs.where("lang is null")).collect()} == {"und"}
    assert {(r.lang_pred, r.score > 0) for r in lid.identify_languages(docs.where("lang = 'fr' or lang is null")).where("text like '%red%'").collect()} <= {("fr", True)}


def test_languages_dont_leak(spark):
    """Neither held-out rows nor null ids teach, and only the text is an input."""
    rows = [(i, "la le les une" if i % 2 else "the of and one", "fr" if i % 2 else "en") for i in range(40)]
    held = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 0]
    wrong = [(i, t, "xx" if i in held else lang) for i, t, lang in rows] + [(None, "the of and one", "yy")]
    make = lambda r: spark.createDataFrame(r, "doc_id long, text string, lang string")
    found = {r.doc_id: r.lang_pred for r in lid.identify_languages(make(wrong)).collect()}
    assert all(found[i] == lang for i, _, lang in rows) and found[None] == "en"


def test_held_out_accuracy(spark):
    found = queries.op11_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id")
    rows = found.where("held_out and lang_pred <> 'und'").select("lang", "lang_pred", "n_chars").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.98
    assert len(rows) > 100


@pytest.mark.parametrize("name", ["op12_collocations", "op13_lexical_search"])
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    found = queries.QUERIES[name](spark, DATA)
    expected = con.sql(queries.ORACLE[name]).fetchall()
    assert found.columns == con.sql(queries.ORACLE[name]).columns and expected
    assert sorted(tuple(r) for r in found.collect()) == sorted(expected)


# large scores of the exact search


@pytest.mark.parametrize("bits", [20, 51, 51.9, 52.4, 60, 70])
def test_large_scores(spark, bits):
    """Ranks are whole and in order at any size; scores are exact below 2**53."""
    from linemetry.llm.exact_topk import exact_top_k

    rng = np.random.default_rng(int(bits * 10))
    size = 2.0 ** (bits / 2) / 64
    rows = [(i, [float(x) for x in rng.integers(-8, 9, 3) / 8 * size]) for i in range(400)] + [(400, [size] * 3), (401, [0.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {}
    for r in exact_top_k(df, df.where("vec_id % 100 = 0"), k=402).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    ints = {i: [math.floor(64 * x) for x in v] for i, v in rows}
    for q, ranks in found.items():
        exact = {i: sum(a * b for a, b in zip(ints[q], v, strict=True)) for i, v in ints.items() if i != q}
        assert sorted(r[0] for r in ranks) == list(range(1, 402)) and {r[1] for r in ranks} == set(exact)
        if bits < 51.4:  # three products
            assert [r[1:] for r in sorted(ranks)] == sorted(exact.items(), key=lambda x: (-x[1], x[0]))
        else:
            near = [min(2**63 - 1, max(-(2**63), exact[r[1]])) for r in sorted(ranks)]
            assert all(a >= b - 2 * abs(b) * 2**-50 - 1 for a, b in zip(near, near[1:], strict=False))
            assert all(abs(r[2] - x) <= abs(x) * 2**-50 for r, x in zip(sorted(ranks), near, strict=True))
