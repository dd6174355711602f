"""The thin queries opN_<name>, one for each numbered operator, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._tables import table
from .bpe import encode_documents
from .collision_ann import approximate_neighbours
from .collocations import collocations
from .exact_topk import exact_top_k
from .language_id import identify_languages
from .lexical_search import lexical_search
from .lm_scoring import score_documents
from .mixing import mix
from .ngram_join import ngram_join
from .quality import score_quality
from .sharding import byte_shards
from .substring_dedup import substring_dedup
from .url_filter import filter_urls

#: The vocabulary file; a parameter of the operator.
VOCABULARY = "word_bpe_49k.json"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_collision_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return approximate_neighbours(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"), k=3, percent=90)


def op4_byte_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_shards(table(spark, sf_dir, "documents"), shards=24)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return exact_top_k(vectors, vectors.where("vec_id % 20 = 0"), k=20, scale=64)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    return score_quality(documents, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), vocabulary_path())


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"), words=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_collision_ann,
        op2_lm_scoring,
        op3_ngram_jaccard_join,
        op4_byte_sharding,
        op5_source_mixing,
        op6_url_filter,
        op7_exact_top_k,
        op8_quality_classifier,
        op9_bpe,
        op10_substring_dedup,
        op11_language_id,
        op12_collocations,
        op13_lexical_search,
    )
}

_WORDS = r"'[^\x20\x09-\x0D]+'"
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_TERMS = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"

ORACLE: dict[str, str] = {
    "op3_ngram_jaccard_join": rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWERED}, {_WORDS}) AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+2], ' ') AS g FROM words, LATERAL (SELECT unnest(range(1, len(w) - 1)) AS i) WHERE len(w) >= 3
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM words WHERE len(w) BETWEEN 1 AND 2),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * o >= 90 * (a.n + b.n - o)),
both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) c ON c.x = d.doc_id""",
    "op7_exact_top_k": """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, r.vec_id, list_inner_product(q.v, r.v)::BIGINT AS score
  FROM vectors q JOIN vectors r ON q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id AND len(q.v) = len(r.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20""",
    "op10_substring_dedup": rf"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
starts AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS g FROM words, LATERAL (SELECT unnest(range(1, len(w) - 11)) AS i) WHERE len(w) >= 13),
firsts AS (SELECT g, min(doc_id) AS first_id FROM starts GROUP BY g),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM starts JOIN firsts USING (g), (SELECT unnest(range(0, 13)) AS j) WHERE first_id < doc_id),
tokens AS (SELECT doc_id, p, w[p] AS word FROM words, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS p)),
kept AS (
  SELECT t.doc_id, count(g.p) AS n_removed, coalesce(string_agg(t.word, ' ' ORDER BY t.p) FILTER (WHERE g.p IS NULL), '') AS kept
  FROM tokens t LEFT JOIN gone g ON g.doc_id = t.doc_id AND g.p = t.p GROUP BY t.doc_id)
SELECT w.doc_id, len(w.w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM words w LEFT JOIN kept k ON k.doc_id = w.doc_id""",
    "op12_collocations": rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS piece, unnest(regexp_split_to_array({_LOWERED}, '[.,;:!?\x0A-\x0D]')) AS text FROM documents),
words AS (SELECT lang, row_number() OVER () AS piece, regexp_extract_all(text, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
phrases AS (SELECT lang, k, w[i:i+k-1] AS p FROM words, (SELECT unnest([1, 2, 3, 4]) AS k), LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i) WHERE len(w) >= k),
counted AS (SELECT lang, k, p, count(*) AS f FROM phrases GROUP BY ALL HAVING count(*) >= 30),
cuts AS (SELECT c.lang, c.p, c.f AS a, c.k, j, l.f AS l, r.f AS r, ((2000000::HUGEINT * c.f) // (l.f + r.f))::BIGINT AS score FROM counted c, LATERAL (SELECT unnest(range(1, c.k)) AS j)
  JOIN counted l ON l.lang = c.lang AND l.p = c.p[1:j] JOIN counted r ON r.lang = c.lang AND r.p = c.p[j+1:] WHERE c.k > 1),
lowest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, j) AS place FROM cuts) WHERE place = 1),
inside AS (SELECT lang, p[i:i+m-1] AS p, max(f) AS over FROM counted, (SELECT unnest([2, 3]) AS m), LATERAL (SELECT unnest(range(1, k - m + 2)) AS i) WHERE k > m GROUP BY ALL),
kept AS (SELECT o.* FROM lowest o LEFT JOIN inside s ON s.lang = o.lang AND s.p = o.p WHERE s.over IS NULL OR 100 * s.over < 80 * o.a),
ranked AS (SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000""",
    "op13_lexical_search": rf"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS row_id, regexp_extract_all({_LOWERED}, {_TERMS}) AS t FROM documents),
sizes AS (SELECT doc_id, row_id, len(t)::HUGEINT AS n FROM docs WHERE len(t) > 0),
whole AS (SELECT count(*)::HUGEINT AS docs, sum(n)::HUGEINT AS length FROM sizes),
asked AS (SELECT item_id, term, count(*) AS often FROM (SELECT item_id, unnest(regexp_extract_all({_LOWERED}, {_TERMS})) AS term FROM benchmark) GROUP BY ALL),
postings AS (SELECT row_id, term, count(*)::HUGEINT AS tf FROM (SELECT row_id, unnest(t) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::HUGEINT AS w FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), whole),
adds AS (SELECT row_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // length))) AS s FROM postings JOIN weights USING (term) JOIN sizes USING (row_id), whole),
scored AS (SELECT item_id, row_id, sum(often * s)::BIGINT AS score FROM asked JOIN adds USING (term) GROUP BY ALL HAVING sum(often * s) > 0),
ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM scored JOIN sizes USING (row_id))
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10""",
}
