"""Near-duplicate documents: b-bit MinHash, band candidates, exact confirmation, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from karst.llm.common import Workspace, components, table

SHINGLE = 5
#: Similarity at which documents are linked, in hundredths.
PERCENT = 75
#: 32 bands of 4 minima: a pair at the threshold shares a band with probability 1 - (1 - 0.75^4)^32 > 0.99999.
BANDS, ROWS = 32, 4
MINIMA = BANDS * ROWS
#: Bits kept of each minimum. Estimates from them have a standard error below 0.045 at the threshold.
BITS = 4
#: Estimates that far below the threshold aren't confirmed: five standard errors.
MARGIN = 0.22
#: Minima of the wide signature, and the same margin for it: 4.5 standard errors.
WIDE, WIDE_MARGIN = 1024, 0.065
CACHE_ENTRIES = 1_000_000
#: Ids of documents to confirm that may be broadcast; so many take less than 64 MB.
BROADCAST_IDS = 2_000_000

_P = np.uint64(0x9E3779B97F4A7C15)  # odd; any would do
_draw = np.random.default_rng(20240607)
_A = (_draw.integers(0, 2**63, MINIMA, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _draw.integers(0, 2**63, MINIMA, dtype=np.uint64)
_A_WIDE = (_draw.integers(0, 2**63, WIDE, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_B_WIDE = _draw.integers(0, 2**63, WIDE, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Shingles(dict):
    """A worker's word hashes; of(text) gives the distinct 64-bit shingle hashes, sorted."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHE_ENTRIES:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, text: str) -> np.ndarray:
        words = text.encode().lower().split()  # bytes: lowers A-Z alone and splits at ASCII white space alone
        if not words:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        size = min(SHINGLE, len(h))
        n = len(h) - size + 1
        acc = np.full(n, size, np.uint64)
        for i in range(size):
            acc = acc * _P + h[i : i + n]
        return np.unique(_mixed(acc))


def minima(shingles: np.ndarray, a: np.ndarray = _A, b: np.ndarray = _B) -> np.ndarray:
    out = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    step = 2**18 // len(a)
    for lo in range(0, len(shingles), step):
        block = a[:, None] * shingles[None, lo : lo + step] + b[:, None]
        np.minimum(out, block.min(axis=1), out=out)
    return out


def _bands(m: np.ndarray) -> np.ndarray:
    acc = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)
    for column in m.reshape(BANDS, ROWS).T:
        acc = _mixed(acc * _P + column)
    return acc.view(np.int64)


def _packed(m: np.ndarray) -> np.ndarray:
    """BITS bits of each minimum, sixteen lanes to a 64-bit word. They're taken from bit 24 on, not from bit 0: the
    lowest bits of a * x + b depend on the lowest bits of x alone, in all permutations alike."""
    lanes = ((m >> np.uint64(24)) & np.uint64(2**BITS - 1)).reshape(-1, 64 // BITS)
    shifts = np.arange(0, 64, BITS, dtype=np.uint64)
    return np.bitwise_or.reduce(lanes << shifts, axis=1).view(np.int64)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, set_hash, bands, signature) of every row; without words the last three are null.
    set_hash: 128 bits of the whole sorted set, equal for equal sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        sets = Shingles()
        for batch in batches:
            counts, hashes, bands, signatures = [], [], [], []
            for text in batch.column(1).to_pylist():
                s = sets.of(text) if text else ()
                counts.append(len(s))
                if len(s):
                    m = minima(s)
                    hashes.append(xxhash.xxh3_128_digest(s.tobytes()))
                    bands.append(_bands(m))
                    signatures.append(_packed(m))
                else:
                    hashes.append(None), bands.append(None), signatures.append(None)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.binary()), pa.array(bands, longs), pa.array(signatures, longs)], names=["doc_id", "n_shingles", "set_hash", "bands", "signature"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_shingles bigint, set_hash binary, bands array<bigint>, signature array<bigint>")


def _sets(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Shingles()
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                piece = batch.slice(lo, 64)
                found = [sets.of(t or "").view(np.int64) for t in piece.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(found, pa.list_(pa.int64()))], names=["id", "shingles"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"id {kind}, shingles array<bigint>")


def _wide(docs: DataFrame) -> DataFrame:
    """(id, wide): signatures of WIDE minima, for the few documents whose narrow ones leave too many pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Shingles()
        for batch in batches:
            found = [_packed(minima(sets.of(t or ""), _A_WIDE, _B_WIDE)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["id", "wide"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"id {kind}, wide array<bigint>")


def _of_ids(work: Workspace, docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents with these ids: the ids are broadcast up to a checked number; else both sides are shuffled."""
    ids = work.keep(ids.distinct(), "ids")
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")


def estimate(a: str, b: str, n: int = MINIMA) -> Column:
    """Similarity from packed signatures of n minima: lanes that agree, less those expected to agree by chance."""
    words, lane = n * BITS // 64, int("1" * (64 // BITS), 16)
    differs = "bit_count(({x} | shiftrightunsigned({x}, 1) | shiftrightunsigned({x}, 2) | shiftrightunsigned({x}, 3)) & %dL)" % lane
    if words <= 8:  # written out, so that it compiles to plain arithmetic
        other = " + ".join(differs.format(x=f"({a}[{i}] ^ {b}[{i}])") for i in range(words))
    else:
        other = f"aggregate(zip_with({a}, {b}, (p, q) -> p ^ q), 0, (t, x) -> t + {differs.format(x='x')})"
    chance = 1 / 2**BITS
    return (F.expr(f"1 - ({other}) / {float(n)}D") - chance) / (1 - chance)


def _confirmed(work: Workspace, docs: DataFrame, reps: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Of (a, b) candidate pairs, those whose full sets are alike enough."""
    of = lambda side: reps.select(F.col("id").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("signature").alias(f"s_{side}"))
    sized = pairs.join(of("a"), "a").join(of("b"), "b")
    sized = sized.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    likely = work.keep(sized.where(estimate("s_a", "s_b") >= percent / 100 - MARGIN).select("a", "b", "n_a", "n_b"), "likely")
    sets = work.keep(_sets(_of_ids(work, docs, likely.select(F.col("a").alias("doc_id")).union(likely.select("b")))).dropDuplicates(["id"]), "sets")
    both = likely.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    links = both.withColumn("common", common).where(100 * F.col("common") >= percent * (F.col("n_a") + F.col("n_b") - F.col("common")))
    links = work.keep(links.select("a", "b"), "confirmed")
    work.drop(sets)
    return links


def near_duplicates(work: Workspace, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs.

    Documents with equal sets form a class, named by its smallest id; only classes are compared. Each band bucket
    links its members to one of them (a star: as many pairs as members), and full sets confirm. The centre is the
    member with most company over all its buckets: copies that were changed in different places are less alike than
    each of them is to what they were made from, and that one shares the most buckets. Where a bucket still holds more than one component, its members of different components meet in an equi-join on the
    bucket whose condition is the estimate, then one from signatures eight times as wide, so that only likely pairs
    come out, and are confirmed too. Within a
    component no further pair can change the result.

    Null, empty and blank texts have no shingle, link with nothing and stay. Repeated rows are copies of each other:
    each row is returned. A row without doc_id names no class; if all rows of its class are such, component_id is
    null; kept is false for it. An empty table gives no row; other columns are not looked at.
    Ids are numbers. Texts of any length are read whole: a set is built in one task, its minima in pieces.
    """
    found = work.keep(features(docs), "features")
    classes = found.where("set_hash is not null and doc_id is not null").groupBy("set_hash")
    reps = classes.agg(F.min(F.struct("doc_id", "n_shingles", "bands", "signature")).alias("r"))
    reps = work.keep(reps.select("set_hash", F.col("r.doc_id").alias("id"), "r.n_shingles", "r.bands", "r.signature"), "classes")
    buckets = reps.select("id", F.explode("bands").alias("bucket"))
    sizes = work.keep(buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    crowded = work.keep(buckets.join(sizes, "bucket"), "crowded")
    company = work.keep(crowded.groupBy("id").agg(F.sum("n").alias("company")), "company")
    known = crowded.select("bucket", "id").join(company, "id")
    centres = work.keep(known.groupBy("bucket").agg(F.max(F.struct("company", F.negative("id").alias("m"))).alias("c")).select("bucket", F.negative("c.m").alias("a")), "centres")
    pairs = crowded.join(centres, "bucket").where("a <> id").select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct()
    links = _confirmed(work, docs, reps, pairs, percent)
    near = components(work, links)

    named = crowded.join(near.withColumnRenamed("id", "i"), F.col("id") == F.col("i"), "left").select("bucket", "id", F.coalesce("component", "id").alias("component"))
    named = work.keep(named, "named")
    mixed = work.keep(named.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket"), "mixed")
    rest = named.join(mixed, "bucket").select("bucket", "id", "component")
    rest = work.keep(rest.join(reps.select("id", "n_shingles", "signature", "bands"), "id"), "rest")
    wide = work.keep(_wide(_of_ids(work, docs, rest.select(F.col("id").alias("doc_id")))).dropDuplicates(["id"]), "wide")
    rest = work.keep(rest.join(wide, "id"), "rest")
    x, y = (rest.select("bucket", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "component", "n_shingles", "signature", "wide", "bands")]) for s in "ab")
    alike = (F.col("component_a") < F.col("component_b")) & (100 * F.least("n_shingles_a", "n_shingles_b") >= percent * F.greatest("n_shingles_a", "n_shingles_b"))
    likely = (estimate("signature_a", "signature_b") >= percent / 100 - MARGIN) & (estimate("wide_a", "wide_b", WIDE) >= percent / 100 - WIDE_MARGIN)
    once = F.array_min(F.array_intersect("bands_a", "bands_b")) == F.col("bucket")  # of the buckets that a pair shares, one
    across = x.join(y, "bucket").where(alike & likely & once)
    more = across.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()
    more = _confirmed(work, docs, reps, more, percent)
    if not more.isEmpty():
        near = components(work, links.unionByName(more))

    of_class = reps.select("set_hash", "id").join(near.withColumnRenamed("id", "i"), F.col("id") == F.col("i"), "left")
    of_class = work.keep(of_class.select(F.col("set_hash").alias("h"), F.coalesce("component", "id").alias("c")), "components")
    out = found.select("doc_id", "n_shingles", "set_hash").join(of_class, F.col("set_hash") == F.col("h"), "left")
    component = F.when(F.col("set_hash").isNull(), F.col("doc_id")).otherwise(F.col("c"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(Workspace(spark, "op1"), table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM w
), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), r AS (
  WITH RECURSIVE t(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT t.a, p.b FROM t JOIN p ON t.b = p.a)
  SELECT a, min(b) AS c FROM t GROUP BY a
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, r.c AS component_id, s.doc_id = r.c AS kept FROM s JOIN r ON r.a = s.doc_id
"""
