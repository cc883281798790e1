"""Document retrieval: chunks, embeddings, nearest neighbours, context."""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karst.functions.text import CHUNK, OVERLAP, recursive_chunks, tokens, with_run_lengths

TOP_K = 5


class Embedder(Protocol):
    """Turns text into a dense vector: over a column for the corpus, over one text for a query."""

    def embed(self, text: Column) -> Column: ...
    def embed_query(self, text: str) -> Sequence[float]: ...


class Chunker(Protocol):
    def __call__(self, df: DataFrame, text: str, size: int, overlap: int) -> DataFrame: ...


class HashedTerms:
    """Offline default: counts of terms in hash buckets, scaled to unit length. A text costs its own terms, in Arrow batches."""

    def __init__(self, buckets: int = 256):
        self.buckets = buckets

    def embed(self, text: Column) -> Column:
        def rows(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: self.embed_query(t or ""))

        return F.pandas_udf(rows, "array<double>")(text)

    def embed_query(self, text: str) -> list[float]:
        places = [zlib.crc32(w.encode()) % self.buckets for w in re.findall("[a-z0-9]+", text.lower())]
        counts = np.bincount(np.array(places, dtype=int), minlength=self.buckets).astype(float)
        length = float(np.sqrt(counts @ counts))
        return (counts / length if length else counts).tolist()


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, d: s + d)


def top_k_l2(vectors: DataFrame, query: Sequence[float], k: int = TOP_K, vector: str = "embedding", key: str | Sequence[str] = "vec_id") -> DataFrame:
    """The k rows nearest to the query, nearest first, ties by key (one column or several); a column distance is added. Each task keeps its
    own k best, so k rows a task travel. Rows without a vector, or with one of another length, are left out."""
    asked = F.array(*[F.lit(float(x)) for x in query])
    rows = vectors.where(F.col(vector).isNotNull() & (F.size(vector) == len(query)))
    return rows.withColumn("distance", squared_l2(F.col(vector), asked)).orderBy("distance", *([key] if isinstance(key, str) else key)).limit(k)


def top_k_terms(df: DataFrame, query: str, k: int = TOP_K, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The k rows most like the query by cosine of term counts, most alike first, ties by key; adds score.

    Sums are whole numbers up to the last division. Each row is judged by itself: nothing is shuffled but the tops.
    """
    from collections import Counter

    asked = Counter(re.findall("[a-z0-9]+", query.lower()))
    own = sum(n * n for n in asked.values())
    weights = F.create_map(*[F.lit(x) for pair in sorted(asked.items()) for x in pair]) if asked else F.create_map().cast("map<string,int>")
    df = df.withColumn("words_", tokens(F.col(text)))
    dot = F.aggregate("words_", F.lit(0).cast("bigint"), lambda s, w: s + F.coalesce(F.element_at(weights, w), F.lit(0)))
    square = F.aggregate("runs_", F.lit(0).cast("bigint"), lambda s, n: s + n.cast("bigint") * n)
    df = with_run_lengths(df.withColumn("dot_", dot).where("dot_ > 0"), "words_", "runs_").withColumn("square_", square)
    return df.withColumn("score", F.col("dot_") / F.sqrt(F.col("square_") * F.lit(own))).orderBy(F.desc("score"), key).limit(k).drop("words_", "dot_", "square_", "runs_")


def context(ranked: DataFrame, rank: Sequence[Column | str], chunk: str = "chunk", between: str = "\n\n") -> DataFrame:
    """One row, content: the chunks in rank order, joined. ranked has few rows (a top-k)."""
    pairs = F.array_sort(F.collect_list(F.struct(*[F.col(r).alias(f"r{i}") if isinstance(r, str) else r.alias(f"r{i}") for i, r in enumerate(rank)], F.col(chunk).alias("c"))))
    return ranked.agg(F.array_join(F.transform(pairs, lambda x: x["c"]), between).alias("content"))


def set_similarity(df: DataFrame, to: Sequence, percent: int = 70, items: str = "items") -> DataFrame:
    """Rows whose set shares at least `percent` hundredths of the union with the given one, itself included; adds
    similarity. Compared in whole numbers. Empty unions are alike to nothing."""
    asked = F.array(*[F.lit(x) for x in to]) if to else F.array().cast(df.schema[items].dataType)
    own, others = F.array_distinct(items), len(set(to))
    df = df.withColumn("own_", F.size(own)).where(F.col("own_") * 100 >= int(percent) * others).where(F.col("own_") * int(percent) <= 100 * others)  # sizes alone tell most rows apart
    both = F.size(F.array_intersect(items, asked))
    df = df.withColumn("both_", both).withColumn("either_", F.col("own_") + others - F.col("both_")).drop("own_")
    return df.where(f"either_ > 0 and 100 * both_ >= {int(percent)} * either_").withColumn("similarity", F.col("both_") / F.col("either_")).drop("both_", "either_")


@dataclass
class Retrieved:
    query: str
    results: DataFrame
    content: str


class RetrievalSystem:
    """Load, chunk, embed, keep; then answer with the nearest chunks."""

    def __init__(self, embedder: Embedder | None = None, chunker: Chunker = recursive_chunks, chunk_size: int = CHUNK, chunk_overlap: int = OVERLAP):
        self.embedder, self.chunker = embedder or HashedTerms(), chunker
        self.chunk_size, self.chunk_overlap = chunk_size, chunk_overlap
        self.index: DataFrame | None = None

    def process_documents(self, documents: DataFrame, text: str = "page_content", path: str | None = None) -> DataFrame:
        """Build the index: cached, or written to path as parquet and read back. No chunks is an error."""
        chunks = self.chunker(documents, text, self.chunk_size, self.chunk_overlap)
        index = chunks.withColumn("embedding", self.embedder.embed(F.col("chunk")))
        if path:
            index.write.mode("overwrite").parquet(path)
            index = documents.sparkSession.read.parquet(path)
        else:
            index = index.cache()
        if index.isEmpty():
            raise ValueError("No document chunks to index.")
        self.index = index
        return index

    def query(self, text: str, top_k: int = TOP_K) -> Retrieved:
        if self.index is None:
            raise ValueError("process_documents() has not run: there are no vectors to search.")
        keys = [c for c in ("doc_id", "path", "chunk_ix") if c in self.index.columns]
        asked = list(self.embedder.embed_query(text))
        found = top_k_l2(self.index, asked, top_k, key=keys)
        content = context(found, ["distance", *keys]).first()["content"]
        return Retrieved(text, found, content)
