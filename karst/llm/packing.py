"""Packing into training sequences: concatenate and cut."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karst.llm.common import Workspace, table
from karst.llm.tokens import check_chunks

WINDOW = 4096
END_ID = 2
#: Text that a task tokenises at once; its distinct chunks are looked up once.
TEXT_BYTES = 8_000_000


def tokenize(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, text_bytes: int = TEXT_BYTES) -> DataFrame:
    """First pass: (part, local_start, id, n_tokens, ids) for each row; part is the task, local_start its tokens so far.

    ids are little-endian unsigned 16-bit where the vocabulary allows, else 32-bit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from karst.llm.tokens import chunk_ids

        lookup = chunk_ids(tokenizer_path)
        width = lookup.kind.itemsize
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            sizes = np.append(0, np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(), dtype=np.int64))
            lo = 0
            while lo < batch.num_rows:  # bounded bytes of text at once, one row at least
                hi = max(lo + 1, int(np.searchsorted(sizes, sizes[lo] + text_bytes, "right")) - 1)
                ids = lookup.all(batch.column(1).slice(lo, hi - lo), end_id)
                counts = pc.binary_length(ids).to_numpy().astype(np.int64) // width
                ends = at + np.append(0, np.cumsum(counts))
                n, at = hi - lo, int(ends[-1])
                made = pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int32()), pa.array(ends[:-1]), batch.column(0).slice(lo, n), pa.array(counts), pa.array([width] * n, pa.int32()), ids],
                    names=["part", "local_start", "doc_id", "doc_tokens", "width", "ids"],
                )
                yield from (made.slice(i, 256) for i in range(0, n, 256))  # long texts: small output batches
                lo = hi

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"part int, local_start bigint, doc_id {kind}, doc_tokens bigint, width int, ids binary")


def pack(work: Workspace, docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece of a document in a sequence of `window` tokens.

    Pass 1 writes each task's documents with running token offsets; the totals of the tasks, one number each, give
    every task's global offset. Pass 2 cuts at multiples of `window`; a document over a boundary gives one piece on
    either side, a task over a boundary shares that sequence with the next. Nothing is shuffled. Only the last
    sequence can be short. Null texts count as empty and hold the end id alone; repeated rows are packed as often
    as they occur; an empty table gives no piece. A text of any length is tokenised whole and cut at every window. Columns other than
    id and text are not looked at. A tokenizer that can't be looked up chunk by chunk is an error.

    Columns: doc_id, start, length, ids_crc32 (unsigned, ids as little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset, sequence_length (tokens with padding: a sequence that is full, or that ends at a power of
    two, has none), ids (binary, `width` bytes an id).
    """
    spark = work.spark
    check_chunks(tokenizer_path)
    rows = work.keep(tokenize(docs, tokenizer_path, end_id=end_id), "tokens")
    totals = {r.part: r.n for r in rows.groupBy("part").agg(F.sum("doc_tokens").alias("n")).collect()}  # a number per task
    bases = dict(zip(sorted(totals), accumulate((totals[p] for p in sorted(totals)), initial=0)))
    total = sum(totals.values())
    base = F.broadcast(spark.createDataFrame(list(bases.items()) or [(0, 0)], "part int, base bigint"))
    first = F.expr(f"at div {window}")
    last = F.expr(f"(at + doc_tokens - 1) div {window}")
    cut = (
        rows.join(base, "part")
        .withColumn("at", F.col("base") + F.col("local_start"))
        .withColumn("sequence_id", F.explode(F.sequence(first, last)))
        .withColumn("start", F.greatest(F.lit(0).cast("bigint"), F.col("sequence_id") * window - F.col("at")))
        .withColumn("end", F.least("doc_tokens", (F.col("sequence_id") + 1) * window - F.col("at")))
        .withColumn("length", F.col("end") - F.col("start"))
        .withColumn("piece", F.expr("substring(ids, cast(start * width as int) + 1, cast(length * width as int))"))
    )
    tail, fill = total // window, total % window
    padded = fill if fill and fill & (fill - 1) == 0 else window
    pieces = cut.select(
        "doc_id", "start", "length", "doc_tokens", "sequence_id",
        (F.col("at") + F.col("start") - F.col("sequence_id") * window).alias("offset"),
        F.when(F.col("sequence_id") == tail, padded).otherwise(window).cast("bigint").alias("sequence_length"),
        "width", F.col("piece").alias("ids"),
    )
    return _with_checksum(pieces)


def _with_checksum(pieces: DataFrame) -> DataFrame:
    """Adds ids_crc32, over the ids as 32-bit whatever their width here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = dict(zip(batch.schema.names, batch.columns))
            raw = ((memoryview(x.as_buffer()) if x.is_valid else b"", w) for x, w in zip(cols["ids"], cols["width"].to_pylist()))
            sums = [zlib.crc32(x if w == 4 else np.frombuffer(x, "<u2").astype("<u4")) for x, w in raw]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.int64())], names=[*batch.schema.names, "ids_crc32"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", ids_crc32 bigint"
    return pieces.mapInArrow(run, schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """Whole sequences (sequence_id, sequence_length, n_tokens, ids): at most `window` pieces meet in a group."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    grouped = pieces.groupBy("sequence_id").agg(F.first("sequence_length").alias("sequence_length"), F.sum("length").alias("n_tokens"), parts.alias("p"))
    return grouped.select("sequence_id", "sequence_length", "n_tokens", F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack(Workspace(spark, "op2"), table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length")
