"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

import math
import zlib
from collections.abc import Sequence
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from karst.llm.common import SPACE, Workspace, shuffle_parts, table

WEIGHTS = (5, 2, 1)
MOST_TIMES = 3
#: Words in a block; the last block of a document is shorter.
BLOCK = 512
#: Blocks of an output shard, on average; more blocks give more shards.
SHARD_BLOCKS = 256
#: Levels of the tree that one task splits: so many halvings, and 2 to that power of leaves.
LEVELS = 12
#: numpy's sampler is exact below this population; above, draw_large is used, which is exact too.
NUMPY_BELOW = 500_000_000


def _ranked(work: Workspace, per: DataFrame) -> DataFrame:
    """per with rank: the place of each source in code-point order, null last. Ranges of sources are sorted by one
    task each; the ranges' sizes, a number a task, come to the driver."""
    order = F.col("source").asc_nulls_last()
    parts = shuffle_parts(work.spark, per.count(), 1_000_000)
    placed = work.keep(per.repartitionByRange(parts, order).sortWithinPartitions(order).withColumn("at", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("at", 33)
    counts = {r.part: r["count"] for r in placed.groupBy(part.alias("part")).count().collect()}  # a number a task
    before = dict(zip(sorted(counts), accumulate((counts[p] for p in sorted(counts)), initial=0)))
    base = F.coalesce(*[F.when(part == p, n) for p, n in before.items()], F.lit(0))
    return placed.withColumn("rank", base + F.col("at").bitwiseAND((1 << 33) - 1)).drop("at")


def source_targets(work: Workspace, sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most_times: int = MOST_TIMES) -> DataFrame:
    """(source, source_size, target, passes, quota) from (source, size): one row a source.

    Sources in code-point order, null last, take the weights in turn and share the sum of all sizes. A target stops
    at `most_times` its source's size and the excess is shared anew by weight, until none is above. Each such round
    is one sum over the sources; sums are of whole numbers, so their order doesn't matter.
    """
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    per = _ranked(work, sizes.groupBy("source").agg(F.sum("size").alias("source_size"))).withColumn("weight", pick)
    per = per.withColumn("brim", F.col("source_size").cast("double") * most_times)
    total = per.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        over = F.col("brim") <= F.lit(level) * F.col("weight")
        taken, rest, now = per.agg(F.sum(F.when(over, F.col("brim"))), F.sum(F.when(~over, F.col("weight"))), F.count(F.when(over, 1))).first()
        if now == full or not rest:
            break
        level, full = (total - (taken or 0.0)) / rest, now
    per = per.withColumn("target", F.least("brim", F.lit(level) * F.col("weight")))
    passes = F.when(F.col("source_size") == 0, 0).otherwise(F.floor(F.col("target") / F.col("source_size"))).cast("long")
    per = per.withColumn("passes", passes).withColumn("quota", F.when(F.col("source_size") == 0, 0).otherwise(F.floor("target") - passes * F.col("source_size")).cast("long"))
    return per.select("source", "source_size", "target", "passes", "quota")


def _stirling_rest(n: np.ndarray) -> np.ndarray:
    """log(n!) less Stirling's formula, by its series above 15 and from log-gamma below.
    At 0, where the formula has no value, what makes up for a factor 1 in its place."""
    m = np.maximum(n, 1.0)
    series = 1 / (12 * m) - 1 / (360 * m**3) + 1 / (1260 * m**5)
    small = np.array([-0.5 * math.log(2 * math.pi), *[math.lgamma(i + 1) - (i + 0.5) * math.log(i) + i - 0.5 * math.log(2 * math.pi) for i in range(1, 16)]])
    return np.where(n > 15, series, small[np.minimum(n, 15).astype(int)])


def _deviance(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """x log(x / mean) + mean - x, without cancellation where x is near its mean."""
    v = (x - mean) / (x + mean)
    near = np.abs(v) < 0.1
    w, total, power = np.where(near, v, 0.0), np.zeros_like(v), np.ones_like(v)
    for j in range(1, 12):  # atanh(w) - w = w^3 / 3 + w^5 / 5 + ...
        power = power * w * w
        total += power / (2 * j + 1)
    return np.where(near, (x - mean) * v + 2 * x * w * total, np.where(x > 0, x * np.log(np.maximum(x, 1.0) / mean), 0.0) + mean - x)


def _log_binomial(x: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """log of the binomial probability without the factor 1 / sqrt(2 pi), as a saddle-point expansion: its error
    doesn't grow with n."""
    y = n - x
    out = _stirling_rest(n) - _stirling_rest(x) - _stirling_rest(y) - _deviance(x, n * p) - _deviance(y, n * (1 - p))
    return out + 0.5 * (np.log(np.maximum(n, 1)) - np.log(np.maximum(x, 1)) - np.log(np.maximum(y, 1)))


def _log_weight(x: np.ndarray, left: np.ndarray, right: np.ndarray, k: np.ndarray) -> np.ndarray:
    """log of the hypergeometric probability of x, up to what doesn't depend on x: two binomials of one p."""
    p = k / (left + right)
    return _log_binomial(x, left, p) + _log_binomial(k - x, right, p)


def draw_large(left: np.ndarray, right: np.ndarray, k: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Hypergeometric draws for populations of any size, by rejection from the ratio of uniforms over a table
    mountain (Stadlober's constants), with weights whose precision doesn't fall with the population."""
    left, right, k = (np.asarray(v, dtype=float) for v in (left, right, k))
    n = left + right
    p = left / n
    mode = np.floor((k + 1) * (left + 1) / (n + 2))
    centre, top = k * p + 0.5, _log_weight(mode, left, right, k)
    width = 1.7155277699214135 * np.sqrt(k * p * (1 - p) * (n - k) / (n - 1) + 0.5) + 0.8989161620588988
    low, high = np.maximum(0.0, k - right), np.minimum(k, left)
    out = np.where(low == high, low, -1.0)
    while (todo := np.flatnonzero(out < 0)).size:
        u, v = 1 - rng.random(todo.size), rng.random(todo.size)
        x = np.floor(centre[todo] + width[todo] * (v - 0.5) / u)
        fits = (x >= low[todo]) & (x <= high[todo])
        x = np.clip(x, low[todo], high[todo])
        taken = fits & (2 * np.log(u) <= _log_weight(x, left[todo], right[todo], k[todo]) - top[todo])
        out[todo[taken]] = x[taken]
    return out.astype(np.int64)


def split_quota(words: np.ndarray, quota: int, rng: np.random.Generator) -> np.ndarray:
    """Exact quotas of the leaves of a binary tree: each node's quota is split by a hypergeometric draw between the
    populations of its two halves. len(words) is a power of two; the leaves' quotas sum to the root's."""
    levels = [words.astype(np.int64)]
    while len(levels[-1]) > 1:
        levels.append(levels[-1].reshape(-1, 2).sum(axis=1))
    got = np.array([quota], dtype=np.int64)
    for pop in reversed(levels[:-1]):
        left, right = pop[0::2], pop[1::2]
        small = left + right < NUMPY_BELOW
        a = np.zeros(len(got), dtype=np.int64)
        a[small] = rng.hypergeometric(left[small], right[small], got[small])
        if not small.all():
            a[~small] = draw_large(left[~small], right[~small], got[~small], rng)
        got = np.stack([a, got - a], axis=1).reshape(-1)
    return got


def _split(held: DataFrame, quotas: DataFrame, seed: int) -> DataFrame:
    """(source, leaf, quota) of (source, node, leaf, words) rows, from the quotas of (source, node): each task splits
    one node's quota down a tree over those of its leaves that hold words, at most 2 ** LEVELS."""
    kind = held.schema["source"].dataType.simpleString()

    def leaves(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("leaf")
        words = np.zeros(1 << max(0, len(rows) - 1).bit_length(), dtype=np.int64)
        words[: len(rows)] = rows["words"].to_numpy()
        name = key[0]
        rng = np.random.default_rng([seed, zlib.crc32(b"\0" if name is None or name != name else str(name).encode()), int(key[1])])
        got = split_quota(words, int(rows["quota"].iloc[0]), rng)[: len(rows)]
        return pd.DataFrame({"source": [name] * len(rows), "leaf": rows["leaf"].to_numpy(), "quota": got})

    of = quotas.select(F.col("source").alias("s"), F.col("leaf").alias("above"), "quota")
    joined = held.join(of, F.col("source").eqNullSafe(F.col("s")) & (F.col("node") == F.col("above"))).drop("s", "above")
    return joined.groupBy("source", "node").applyInPandas(leaves, f"source {kind}, leaf long, quota long")


def draw(work: Workspace, sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most_times: int = MOST_TIMES, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(targets, blocks) for (doc_id, source, row, copy, size) rows.

    blocks: a row per block of every row: its keys, size, block, n (its words), shard, took (words drawn beyond whole
    passes) and place (its order in the shard after the local shuffle).
    A shard holds the blocks that hash to it, so shards are disjoint; within a shard each source's blocks are taken
    in the order of a second hash until the shard's quota of that source is met, the last of them in part. Every
    source's quota is met to the word. The tree over shards is split in stretches of LEVELS halvings, so no task holds
    more than one stretch. Keys are (source, shard), so a hot source is dealt over all shards.
    """
    targets = work.keep(source_targets(work, sizes, weights, most_times), "targets")
    blocks = sizes.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.lit(0).cast("long"), F.expr(f"(size - 1) div {BLOCK}")))))
    blocks = blocks.withColumn("n", F.when(F.col("block").isNull(), 0).otherwise(F.least(F.lit(BLOCK).cast("long"), F.col("size") - F.col("block") * BLOCK)).cast("long"))
    count = sizes.agg(F.sum(F.expr(f"greatest(1, (size + {BLOCK - 1}) div {BLOCK})"))).first()[0] or 0
    depth = max(4, max(0, -(-count // SHARD_BLOCKS) - 1).bit_length())
    hashed = lambda salt: F.xxhash64(F.lit(seed), F.lit(salt), "doc_id", "source", "row", "copy", "block")
    blocks = blocks.withColumn("shard", F.pmod(hashed("shard"), F.lit(1 << depth))).withColumn("turn", hashed("turn"))

    held = work.keep(blocks.groupBy("source", "shard").agg(F.sum("n").alias("words")), "held")
    quotas = targets.select("source", F.lit(0).cast("long").alias("leaf"), "quota")
    for left in range((depth - 1) // LEVELS * LEVELS, -1, -LEVELS):  # halvings below this stretch
        stretch = held.groupBy("source", F.shiftright("shard", left + LEVELS).alias("node"), F.shiftright("shard", left).alias("leaf")).agg(F.sum("words").alias("words"))
        quotas = work.keep(_split(stretch, quotas, seed * 64 + left), "quotas")
    quotas = quotas.select(F.col("source").alias("q_source"), F.col("leaf").alias("q_shard"), F.col("quota"))
    turns = W.partitionBy("source", "shard").orderBy("turn", "doc_id", "row", "copy", "block").rowsBetween(W.unboundedPreceding, 0)
    blocks = blocks.withColumn("upto", F.sum("n").over(turns))
    blocks = blocks.join(quotas, F.col("source").eqNullSafe(F.col("q_source")) & (F.col("shard") == F.col("q_shard")))
    took = F.greatest(F.lit(0).cast("long"), F.least("n", F.col("quota") - F.col("upto") + F.col("n")))
    return targets, blocks.withColumn("took", took).withColumn("place", F.xxhash64(F.lit(seed), F.lit("place"), "turn")).drop("turn", "upto", "quota", "q_source", "q_shard")


def _row_hash(docs: DataFrame) -> Column:
    """A hash of all columns that can be hashed: rows that agree in it are copies of each other."""
    return F.xxhash64(*[F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t and "variant" not in t])


def sizes_of(docs: DataFrame) -> DataFrame:
    """(doc_id, source, row, copy, size), one row each row of docs: row tells rows of one id apart, copy numbers equal
    rows, which are counted before they're numbered. Null texts have no words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "source", _row_hash(docs).alias("row"), F.size(F.array_remove(F.split(text, SPACE, -1), "")).cast("long").alias("size"))
    counted = rows.groupBy("doc_id", "source", "row").agg(F.max("size").alias("size"), F.count("*").alias("copies"))
    return counted.select("doc_id", "source", "row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"), "size")


def mix(work: Workspace, docs: DataFrame, weights: Sequence[int] = WEIGHTS, most_times: int = MOST_TIMES, seed: int = 0) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source) for every row: its words in the mix, repeats counted.

    taken is whole passes over the source plus the words of the drawn blocks; a source's sum is its target rounded
    down, a row's at most `most_times` its size. Empty and null texts have size and taken 0; a null source is a source,
    a null id an id; repeated rows are drawn each by itself; texts of any length are cut in blocks; an empty table
    gives no row. Columns besides doc_id, text and source only tell rows of one id apart. Reruns agree: hashes are the
    only chance.
    """
    sizes = work.keep(sizes_of(docs), "sizes")
    targets, blocks = draw(work, sizes, weights, most_times, seed)
    per = blocks.groupBy("doc_id", "source", "row", "copy").agg(F.max("size").alias("size"), F.sum("took").alias("took"))
    t = targets.withColumnRenamed("source", "t_source")
    out = per.join(t, F.col("source").eqNullSafe(F.col("t_source")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("passes") * F.col("size") + F.col("took")).alias("taken"), "source")


def mixed_documents(work: Workspace, docs: DataFrame, weights: Sequence[int] = WEIGHTS, most_times: int = MOST_TIMES, seed: int = 0) -> DataFrame:
    """The mix itself: each row as many times as there are whole passes over its source, and once more with the words
    of its drawn blocks, if any (its own text where all of it was drawn); as many words as mix() says. Columns are
    those of docs, with n_chars counted anew where there is such a column. Rows without words stay once, with no word
    to weigh; the rest is as in mix()."""
    sizes = work.keep(sizes_of(docs), "sizes")
    targets, blocks = draw(work, sizes, weights, most_times, seed)
    drawn = F.array_sort(F.collect_list(F.when(F.col("took") > 0, F.struct("block", "took"))))
    per = blocks.groupBy("doc_id", "source", "row", "copy").agg(F.max("size").alias("_size"), F.sum("took").alias("_took"), drawn.alias("_drawn"))
    t = targets.select(F.col("source").alias("t_source"), "passes")
    per = per.join(t, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    per = work.keep(per.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("row").alias("_row"), "copy", "_size", "_took", "_drawn", "passes"), "drawn")
    whole = F.when(F.col("_size") == 0, 1).otherwise(F.col("passes") + F.when(F.col("_took") == F.col("_size"), 1).otherwise(0))
    part = F.when((F.col("_took") > 0) & (F.col("_took") < F.col("_size")), F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>"))
    copies = F.concat(F.array_repeat(F.lit(False), whole.cast("int")), part)
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("_hash") == F.col("_row"))
    named = docs.withColumn("_hash", _row_hash(docs))
    again = per.where("copy > 1").select("_id", "_source", "_row").distinct()
    if again.isEmpty():
        out = named.join(per, same)
    else:  # of equal rows one stands for all, and meets the draws of each
        again = work.keep(again, "again")
        out = named.join(again, same, "left_anti").unionByName(named.join(again, same, "left_semi").dropDuplicates(["doc_id", "source", "_hash"])).join(per, same)
    out = out.withColumn("_cut", F.explode(copies))
    body = F.array_remove(F.split(F.col("text"), SPACE, -1), "")
    cut = F.expr(f"concat_ws(' ', flatten(transform(_drawn, b -> slice(_words, cast(b.block * {BLOCK} + 1 as int), cast(b.took as int)))))")
    out = out.withColumn("_words", F.when(F.col("_cut"), body)).withColumn("text", F.when(F.col("_cut"), cut).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(Workspace(spark, "op10"), table(spark, sf_dir, "documents"))
