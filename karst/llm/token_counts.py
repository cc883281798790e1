"""Exact token counts by a two-tier, map-side lookup."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karst.llm.common import table

#: Pre-tokens that the broadcast table holds: at most this many, each shorter than LONGEST, so below 4 MB.
FREQUENT = 65_536
LONGEST = 24
#: Pre-tokens a task reports from its own part of the corpus.
FREQUENT_PER_TASK = 4_096
#: Entries of a worker's own cache before it is emptied.
CACHE_ENTRIES = 1_000_000

#: A run of spaces and what follows: no piece of the vocabulary has a space after another character, so these runs
#: are encoded independently.
_PRE_TOKEN = re.compile(" +[^ ]*")


def pre_tokens(text: str) -> list[str]:
    """The text's pre-tokens, without the one space that the library itself puts before each text it encodes."""
    text = text.replace("▁", " ")  # the library's own mark for a space: alike to it from here on
    if "  " not in text and text[-1:] != " " and text[:1] != " ":
        return text.split(" ")
    return [m[1:] for m in _PRE_TOKEN.findall(" " + text)]


class Lengths(dict):
    """Pre-token -> number of tokens; starts with the frequent ones and encodes what it lacks."""

    def __init__(self, path: str, frequent: dict[str, int]):
        import sentencepiece

        super().__init__(frequent)
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.frequent = frequent

    def __missing__(self, chunk: str) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
            self.update(self.frequent)
        # a pre-token that is one space has no text of its own, yet stands for a space: measure it before a letter
        n = len(self.library.encode(chunk, num_threads=1)) if chunk else len(self.library.encode(" a", num_threads=1)) - len(self.library.encode("a", num_threads=1))
        self[chunk] = n
        return n

    def of(self, text: str) -> int:
        return sum(map(self.__getitem__, pre_tokens(text))) if text else 0


def check_additive(path: str) -> None:
    """Refuse a model whose text is changed before encoding, or that has pieces with a space inside."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=path)
    inner = next((p for p in map(library.id_to_piece, range(library.get_piece_size())) if "▁" in p.lstrip("▁")), None)
    if inner is not None or library.encode(" a") == library.encode("a"):
        raise ValueError(f"{path}: token counts of this model are not sums over its pre-tokens ({inner!r})")


def frequent_lengths(docs: DataFrame, path: str, text_col: str = "text", most: int = FREQUENT) -> dict[str, int]:
    """Lengths of the corpus' most frequent pre-tokens. Tasks count their own rows and report their top few
    thousand; only those reports meet, so the table is bounded and no pre-token is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    seen.update(text.split(" "))
            if len(seen) > 50 * FREQUENT_PER_TASK:
                seen = Counter(dict(seen.most_common(10 * FREQUENT_PER_TASK)))
        top = [(w, n) for w, n in seen.most_common(FREQUENT_PER_TASK) if w and len(w) < LONGEST]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["w", "n"])

    tops = docs.select(text_col).mapInArrow(run, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n"))
    found = [r.w for r in tops.orderBy(F.desc("n"), "w").limit(most).collect()]
    measure = Lengths(path, {})
    return {w: measure[w] for w in found}


def token_counts(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row, exactly as the library counts the whole text.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows stay; texts of any length are counted whole;
    an empty table gives no row; other columns are not looked at. Special strings in a text are ordinary text.
    """
    check_additive(path)
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = Lengths(path, frequent.value)
        for batch in batches:
            counts = pa.array([lengths.of(t or "") for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), counts], names=["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    sized = docs.select(id_col, text_col, F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint").alias("n_bytes"))
    return sized.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
