"""URL filter: host word segmentation by unigram Viterbi, then multinomial naive Bayes."""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tables import stored

#: Rules (host, path, verdict) of the query.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Words by which pages are labelled before the classifier is trained.
UNWANTED = ("ads", "adult", "bet", "bets", "betting", "casino", "cheap", "free", "gambling", "malware", "pills", "poker", "porn", "sex", "slots", "spam", "track", "tracker", "viagra", "warez", "win", "xxx")
#: Tokens and hosts of at least one in HOT of all rows or occurrences, so HOT of them at most, are
#: sent to the tasks; all others are joined. Rows of a substring are split over SALTS.
HOT, SALTS = 10_000, 16
LONGEST_WORD = 24


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ://."""
    rest = F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def split(name: str, counts: dict[str, int], total: int) -> list[str]:
    """The words of highest total log-probability that a concatenated name is made of; `counts`
    has those of its substrings that are words."""
    unknown = math.log(1 / total)

    def word(w: str) -> float:
        n = counts.get(w)
        return math.log(n / total) if n else unknown - 3.0 * len(w)  # unknown words cost by length

    best, back = [0.0], [0]
    for i in range(1, len(name) + 1):
        value, at = max((best[j] + word(name[j:i]), j) for j in range(max(0, i - LONGEST_WORD), i))
        best.append(value)
        back.append(at)
    words, i = [], len(name)
    while i:
        words.append(name[back[i] : i])
        i = back[i]
    return words[::-1]


def is_joined(w: str, words: set[str]) -> bool:
    """Whether w is two or more other words of at least three letters in a row."""
    reach = [True] + [False] * len(w)
    for i in range(3, len(w) + 1):
        reach[i] = any(reach[j] and i - j < len(w) and w[j:i] in words for j in range(max(0, i - LONGEST_WORD), i - 2))
    return reach[-1]


_PIECE = re.compile(r"[^\W\d_]+|\d+")


def pieces(text: str) -> list[str]:
    """Runs of letters; runs of digits all become one token."""
    return ["0" if p.isdigit() else p for p in _PIECE.findall(text.lower())]


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while held := list(itertools.islice(rows, 1 << 16)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _counted(batches: Iterator[pa.RecordBatch], keys, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Partial counts (key, how often in good rows, in bad ones) of `keys`(batch): (key, bad) pairs."""
    seen: dict[str, list[int]] = {}

    def rows() -> Iterator[tuple]:
        for b in batches:
            for key, bad in keys(b):
                seen.setdefault(key, [0, 0])[bad] += 1
            if len(seen) >= 1 << 19:
                yield from ((k, *n) for k, n in seen.items())
                seen.clear()
        yield from ((k, *n) for k, n in seen.items())

    yield from _batches(rows(), schema)


_COUNTED = "token string, good_n long, bad_n long"
_COUNTED_ARROW = pa.schema([("token", pa.string()), ("good_n", pa.int64()), ("bad_n", pa.int64())])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of the words of hosts and paths, which rows (host, path) have."""

    def keys(b: pa.RecordBatch) -> Iterator[tuple[str, bool]]:
        for text in itertools.chain(b.column(0).to_pylist(), b.column(1).to_pylist()):
            yield from ((w, False) for w in pieces(text or "") if w != "0" and len(w) <= LONGEST_WORD)

    return _counted(batches, keys, _COUNTED_ARROW)


def _token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def keys(b: pa.RecordBatch) -> Iterator[tuple[str, bool]]:
        for tokens, bad in zip(b.column("tokens").to_pylist(), b.column("bad").to_pylist(), strict=True):
            yield from ((t, bad) for t in tokens)

    return _counted(batches, keys, _COUNTED_ARROW)


def _substrings(least: int):
    """(id, substring, salt) of the letter runs of rows (id, name): at least `least` letters each."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for i, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                runs = {p for p in pieces(name) if p != "0"}
                for w in {r[x:y] for r in runs for x in range(len(r)) for y in range(x + least, min(len(r), x + LONGEST_WORD) + 1)}:
                    yield i, w, i % SALTS

    schema = pa.schema([("id", pa.int64()), ("word", pa.string()), ("salt", pa.int32())])
    return lambda batches: _batches(rows(batches), schema)


def _with_words(names: DataFrame, counts: DataFrame, least: int) -> DataFrame:
    """`names` (id, name) with `found`: the words of `counts` (word, n) that occur in each."""
    parts = names.select("id", "name").mapInArrow(_substrings(least), "id long, word string, salt int")
    salted = counts.withColumn("salt", F.explode(F.lit(list(range(SALTS)))))
    found = parts.join(salted, ["word", "salt"]).groupBy("id").agg(F.collect_list(F.struct("word", "n")).alias("found"))
    return names.join(found, "id", "left")


def _joined_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for b in batches:
            for name, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if is_joined(name, {r["word"] for r in found or ()}):
                    yield (name,)

    yield from _batches(rows(), pa.schema([("word", pa.string())]))


def _host_words(total: int):
    """Rows (host, n, found) with the words of the host in place of those found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for host, found in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                counts = {r["word"]: r["n"] for r in found or ()}
                out.append([w for p in pieces(host) for w in (split(p, counts, total) if p != "0" else [p])])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.string()))], ["host", "n", "words"])

    return run


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (.., path, words, ..) with the tokens of the host and the path in place of words."""
    for b in batches:
        words, paths = b.column("words").to_pylist(), b.column("path").to_pylist()
        out = pa.array([w + ["/" + p for p in pieces(path)] for w, path in zip(words, paths, strict=True)], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([out if c == "words" else b.column(c) for c in b.schema.names], ["tokens" if c == "words" else c for c in b.schema.names])


def filter_urls(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, unwanted: tuple[str, ...] = UNWANTED, labels: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, log_odds, tokens for every row of `pages` (page_id, url).

    The longest rule that fits decides: its host is the url's or a parent domain, and the path
    starts with its path. Else the method does: naive Bayes over the words of the segmented host
    and of the path. The dictionary is the words (up to 24 letters) of all hosts and paths,
    and `unwanted`. The classifier learns from all pages: from `labels` (page_id, unwanted boolean;
    true wins where a page has several) for pages that are there, and for others from weak labels,
    by whether the segmented words of the host have an unwanted one; so words that go along with
    unwanted ones count too. Both tables are of all words, and are joined, so neither has a greatest size. Urls that are null or have no :// have empty parts and no tokens: the priors
    decide, floored so that they allow; so they do for all urls where all pages are of one class. Rows with a null page_id and repeated rows give a row
    each; an empty table gives an empty result; other columns (html too), whatever their names, are never read.
    """
    spark = pages.sparkSession
    host, path = url_parts(F.col("url"))
    parts = stored(pages.select(F.monotonically_increasing_id().alias("id"), F.col("page_id").cast("long").alias("page_id"), "url").select("id", "page_id", host.alias("host"), path.alias("path")), "url-parts")
    # unigram counts over all rows, summed in each task first
    counts = stored(parts.select("host", "path").mapInArrow(_words, _COUNTED).groupBy(F.col("token").alias("word")).agg(F.sum("good_n").alias("n")), "url-counts")
    whole = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    typical = max(1, (whole.n or 0) // max(1, whole.v))
    least = F.col("word").isin(*unwanted)
    known = {r.word for r in counts.where(least).collect()}
    missing = spark.createDataFrame([(w, typical) for w in unwanted if w not in known], "word string, n long")
    counts = stored(counts.withColumn("n", F.when(least, F.greatest("n", F.lit(typical))).otherwise(F.col("n"))).unionByName(missing), "url-counts")
    # a name seen in a host must not hide the words that it is made of
    long_words = stored(counts.where("length(word) >= 6").select(F.monotonically_increasing_id().alias("id"), F.col("word").alias("name")), "url-words")
    joined = _with_words(long_words, counts, 3).select("name", "found").mapInArrow(_joined_words, "word string")
    atoms = stored(counts.join(joined, "word", "left_anti"), "url-atoms")
    total = (atoms.agg(F.sum("n")).first()[0] or 0) + 1
    names = stored(parts.groupBy(F.col("host").alias("name")).agg(F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()), "url-hosts")
    hosts = _with_words(names, atoms, 1).select(F.col("name").alias("host"), "n", "found").mapInArrow(_host_words(total), "host string, n long, words array<string>")
    # tokens of paths begin with /, so a page is as unwanted as its host
    bad = F.coalesce(F.arrays_overlap("words", F.array(*[F.lit(w) for w in unwanted])), F.lit(False))
    hosts = stored(hosts.withColumn("bad", bad), "url-hosts")
    hot = F.col("n") * HOT >= (hosts.agg(F.sum("n")).first()[0] or 0)
    often = hosts.where(hot).drop("n")
    rows = parts.join(F.broadcast(often), "host").unionByName(parts.join(F.broadcast(often.select("host")), "host", "left_anti").join(hosts.where(~hot).drop("n"), "host"))
    if labels is not None:
        known = labels.where("page_id is not null and unwanted is not null").groupBy(F.col("page_id").cast("long").alias("page_id")).agg(F.max("unwanted").alias("label"))
        rows = rows.join(known, "page_id", "left").withColumn("bad", F.coalesce("label", "bad")).drop("label")
    tokens = stored(rows.select("id", "page_id", "host", "path", "words", "bad").mapInArrow(_tokens, "id long, page_id long, host string, path string, tokens array<string>, bad boolean"), "url-tokens")
    prior = tokens.agg(F.sum(F.col("bad").cast("long")).alias("bad"), F.count("*").alias("n")).first()
    per_word = stored(tokens.select("tokens", "bad").mapInArrow(_token_counts, _COUNTED).groupBy("token").agg(F.sum("good_n").alias("good_n"), F.sum("bad_n").alias("bad_n")), "url-odds")
    seen = per_word.agg(F.sum("good_n").alias("good"), F.sum("bad_n").alias("bad"), F.count("*").alias("v")).first()
    bad_total, good_total = (seen.bad or 0) + seen.v + 1, (seen.good or 0) + seen.v + 1
    # of one class alone nothing can be learnt
    learnt = F.log((F.col("bad_n") + 1) / bad_total) - F.log((F.col("good_n") + 1) / good_total) if 0 < (prior.bad or 0) < prior.n else F.lit(0.0)
    odds = per_word.select("token", learnt.alias("odds"), ((F.col("good_n") + F.col("bad_n")) * HOT >= (seen.good or 0) + (seen.bad or 0)).alias("hot"))
    of = {r.token: r.odds for r in odds.where("hot").collect()}
    start = min(math.log(((prior.bad or 0) + 1) / ((prior.n or 0) - (prior.bad or 0) + 1)), -1e-9)
    scored = tokens.drop("bad").mapInArrow(_scores(spark.sparkContext.broadcast(of), start), "id long, page_id long, host string, path string, tokens array<string>, log_odds double, rest array<string>")
    if seen.v > len(of):
        rare = scored.select("id", F.explode("rest").alias("token")).join(odds.where("not hot"), "token").groupBy("id").agg(F.sum("odds").alias("more"))
        scored = scored.join(rare, "id", "left").withColumn("log_odds", F.col("log_odds") + F.coalesce("more", F.lit(0.0)))
    fits = [(len(h + p), h + p, v, ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)) for h, p, v in rules]
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("log_odds") > 0, "block").otherwise("allow")
    for _, name, what, fit in sorted(fits, key=lambda x: x[0]):  # the longest is tested last, so it wins
        rule, verdict = F.when(fit, name).otherwise(rule), F.when(fit, what).otherwise(verdict)
    return scored.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "log_odds", "tokens")


def _scores(odds, start: float):
    """Rows (.., tokens) with the prior and the odds of the tokens sent, and the other tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = odds.value
        for b in batches:
            tokens = b.column("tokens").to_pylist()
            sums = [start + sum([of.get(t, 0.0) for t in x]) for x in tokens]
            rest = [[t for t in x if t not in of] for x in tokens]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sums, pa.float64()), pa.array(rest, pa.list_(pa.string()))], [*b.schema.names, "log_odds", "rest"])

    return run
