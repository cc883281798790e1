"""Language of web pages: text likelihoods fused with declared language, address and host priors."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from karst.llm.common import Workspace, table
from karst.llm.extraction import article, parsed

#: Labelled documents the text model is fitted on at most (smallest hashes of doc_id first).
TRAIN_ROWS = 8_000
#: Buckets of hashed letter trigrams; both ends of a word count as letters.
BUCKETS = 1 << 15
#: Trigrams a text counts for at most: neighbours aren't independent, so more text is no more evidence.
MOST_EVIDENCE = 60.0
#: Pages a parent level (registered domain, suffix, everything) counts for in a host's prior.
PRIOR_PAGES = 5.0
#: Pages added to each cell of P(mark | language).
MARK_PAGES = 0.5
CACHE_ENTRIES = 500_000

_WORD = re.compile(r"[^\W\d_]+")
_PATH = re.compile(r"^/([A-Za-z]{2})(?:[-_][A-Za-z]{2})?(?:/|$)")


def trigrams(word: str) -> list[int]:
    marked = f"^{word}$".encode("utf-32-le")
    return [zlib.crc32(marked[i : i + 12]) % BUCKETS for i in range(0, len(marked) - 8, 4)]


class WordScores(dict):
    """Word -> row of `rows`: the sum of its trigrams' log likelihoods by language, and their number."""

    def __init__(self, logs: np.ndarray):
        super().__init__()
        self.logs, self.rows, self.used = logs, np.zeros((1024, logs.shape[0] + 1)), 0

    def __missing__(self, word: str) -> int:
        if self.used == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        grams = trigrams(word)
        self.rows[self.used, :-1] = self.logs[:, grams].sum(axis=1)
        self.rows[self.used, -1] = len(grams)
        self[word] = self.used
        self.used += 1
        return self.used - 1

    def of(self, text: str) -> np.ndarray:
        """Log likelihoods, scaled to at most MOST_EVIDENCE trigrams; zeros for a text without letters."""
        if len(self) >= CACHE_ENTRIES:
            self.clear()
            self.used = 0
        words = _WORD.findall(text.lower())
        if not words:
            return np.zeros(self.logs.shape[0])
        places = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        total = self.rows[places].sum(axis=0)
        return total[:-1] * min(1.0, MOST_EVIDENCE / total[-1])


def fit_text_model(docs: DataFrame, most: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """(languages, log P(trigram bucket | language)) from a bounded sample of documents with a language."""
    picked = docs.where("lang is not null and lang <> '' and text is not null and doc_id is not null").select("doc_id", "lang")
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id", "lang").limit(most).withColumnRenamed("doc_id", "id").select("id").distinct()
    rows = docs.where("text is not null and lang is not null and lang <> ''").join(F.broadcast(picked), F.col("doc_id") == F.col("id"), "left_semi").select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                mine = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for word in _WORD.findall(text.lower()):
                    for g in trigrams(word):
                        mine[g] += 1
        for lang, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])], names=["lang", "g", "n"])

    found = rows.mapInArrow(run, "lang string, g int, n bigint").groupBy("lang", "g").agg(F.sum("n").alias("n"))
    totals: dict[str, int] = {}
    cells = found.collect()  # at most BUCKETS rows for each language of the sample
    for r in cells:
        totals[r.lang] = totals.get(r.lang, 0) + r.n
    languages = sorted(totals)
    counts = np.full((len(languages), BUCKETS), 0.05)
    place = {x: i for i, x in enumerate(languages)}
    for r in cells:
        if r.lang in place:
            counts[place[r.lang], r.g] += r.n
    return languages, np.log(counts / counts.sum(axis=1, keepdims=True)) if languages else counts


def host_of(url: str | None) -> tuple[str, str]:
    """(host in lower case without port, language that the address names or '')."""
    try:
        parts = urlsplit(url or "")
        host = (parts.hostname or "").strip(".")
        named = _PATH.match(parts.path or "")
    except ValueError:
        return "", ""
    return host, named[1].lower() if named else ""


def evidence(pages: DataFrame, languages: list[str], logs: np.ndarray) -> DataFrame:
    """Adds text_logs and post (by language, in order), declared and named (places of languages, their number for
    others, null for none), host."""
    kept = [c for c in pages.columns if c not in ("text_logs", "post", "declared", "named", "host")]
    told = pages.sparkSession.sparkContext.broadcast(logs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = WordScores(told.value)
        place = {x: i for i, x in enumerate(languages)}
        for batch in batches:
            logs_, posts, declared, named, hosts = [], [], [], [], []
            for html, url in zip(batch.column(len(kept)).to_pylist(), batch.column(len(kept) + 1).to_pylist()):
                page = parsed(html)
                z = scores.of(article(page))
                p = np.exp(z - z.max())
                logs_.append(z.tolist()), posts.append((p / p.sum()).tolist())
                mark = page.declared
                host, path = host_of(url)
                suffix = host.rpartition(".")[2]
                address = path if path in place else suffix if suffix in place else None
                declared.append(place.get(mark, len(languages)) if mark else None)
                named.append(place.get(address) if address else None)
                hosts.append(host)
            doubles = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(logs_, doubles), pa.array(posts, doubles), pa.array(declared, pa.int32()), pa.array(named, pa.int32()), pa.array(hosts, pa.string())], names=[*kept, "text_logs", "post", "declared", "named", "host"])

    schema = "".join(f"`{c}` {pages.schema[c].dataType.simpleString()}, " for c in kept) + "text_logs array<double>, post array<double>, declared int, named int, host string"
    return pages.select(*[f"`{c}`" for c in kept], F.col("html").alias("html_"), F.col("url").alias("url_")).mapInArrow(run, schema)


def mark_logs(seen: DataFrame, mark: str, n: int) -> list[list[float]]:
    """log P(mark | language) for each value of the mark (n languages and 'other'), from expected counts."""
    sums = [F.sum(F.get("post", i)).alias(f"s{i}") for i in range(n)]
    rows = {r[mark]: [r[f"s{i}"] or 0.0 for i in range(n)] for r in seen.where(f"{mark} is not null").groupBy(mark).agg(*sums).collect()}  # n + 1 rows
    cell = [[rows.get(v, [0.0] * n)[i] + MARK_PAGES for i in range(n)] for v in range(n + 1)]
    total = [sum(cell[v][i] for v in range(n + 1)) for i in range(n)]
    return [[math.log(cell[v][i] / total[i]) for i in range(n)] for v in range(n + 1)]


def host_counts(seen: DataFrame, n: int) -> DataFrame:
    """One row a host: own, d, s: expected pages by language of the host, its registered domain (two labels) and its
    suffix."""
    sums = lambda col, name: F.array(*[F.sum(F.get(col, i)) for i in range(n)]).alias(name)
    hosts = seen.groupBy("host").agg(sums("post", "own"))
    hosts = hosts.withColumn("domain", F.substring_index("host", ".", -2)).withColumn("suffix", F.substring_index("host", ".", -1))
    domains = hosts.groupBy("domain").agg(sums("own", "d"))
    suffixes = hosts.groupBy("suffix").agg(sums("own", "s"))
    return hosts.join(domains, "domain").join(suffixes, "suffix").select("host", "own", "d", "s")


def identify(work: Workspace, pages: DataFrame, labelled: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """pages' page_id and url with lang, confidence, text_lang, declared, address, host: one row a page.

    log P(lang | page) is the sum of the text's log likelihood, log P(declared | lang), log P(address | lang) and
    the log of the host's prior; the page's own share is taken out of the counts of its host, domain and suffix, and
    each level is smoothed by the next. Ties go to the first language by code point. Pages without text, mark or
    address are judged by what is left; null html and url are empty. Repeated rows are judged each; pages of
    any length are read whole; an empty table gives no row; without labelled documents lang is null.
    """
    languages, logs = fit_text_model(labelled, most)
    n = len(languages)
    if not n:
        return pages.select("page_id", "url", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence"), *[F.lit(None).cast("string").alias(c) for c in ("text_lang", "declared", "address", "host")])
    seen = work.keep(evidence(pages.select("page_id", "url", "html"), languages, logs).drop("html"), "evidence")
    hosts = work.keep(host_counts(seen, n), "hosts")
    constant = lambda rows: F.expr(f"from_json('{[[round(x, 6) for x in r] for r in rows]}', 'array<array<double>>')")
    flat = lambda mark, rows: F.coalesce(F.get(constant(rows), F.col(mark)), F.array_repeat(F.lit(0.0), n))
    df = seen.join(hosts.withColumnRenamed("host", "h"), F.col("host") == F.col("h")).drop("h")
    less = lambda col: F.zip_with(col, "post", lambda a, b: F.greatest(F.lit(0.0), a - b))
    uniform = F.array_repeat(F.lit(1.0 / n), n)
    everything = hosts.agg(*[F.sum(F.get("own", i)) for i in range(n)]).first()  # n numbers
    df = df.withColumn("g", F.array(*[F.lit(float(x or 0.0)) for x in everything]))

    def smoothed(counts: Column, parent: Column) -> Column:
        total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(counts, parent, lambda c, p: (c + PRIOR_PAGES * p) / (total + PRIOR_PAGES))

    df = df.withColumn("p", smoothed(less("g"), uniform))
    for level in ("s", "d", "own"):
        df = df.withColumn("p", smoothed(less(level), F.col("p")))
    both = F.zip_with("text_logs", "p", lambda a, b: a + F.log(b))
    both = F.zip_with(both, flat("declared", mark_logs(seen, "declared", n)), lambda a, b: a + b)
    df = df.withColumn("logs", F.zip_with(both, flat("named", mark_logs(seen, "named", n)), lambda a, b: a + b))
    best = F.array_position("logs", F.array_max("logs")).cast("int")
    codes = F.array(*[F.lit(x) for x in [*languages, "other"]])
    weight = F.aggregate(F.transform("logs", lambda x: F.exp(x - F.array_max("logs"))), F.lit(0.0), lambda a, x: a + x)
    text_best = F.when(F.exists("text_logs", lambda x: x != 0), F.element_at(codes, F.array_position("text_logs", F.array_max("text_logs")).cast("int")))
    return df.select("page_id", "url", F.element_at(codes, best).alias("lang"), (1 / weight).alias("confidence"), text_best.alias("text_lang"), F.get(codes, F.col("declared")).alias("declared"), F.get(codes, F.col("named")).alias("address"), "host")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(Workspace(spark, "op8"), table(spark, sf_dir, "pages"), docs)
