"""Quality rules and a hashed n-gram likelihood ratio, with built-in functions alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from karst.llm.common import SPACE, let, table

#: Hash buckets of the two multinomials. Both tables have this many rows, whatever the corpus holds.
BUCKETS = 16_384
#: Labelled rows that the trusted multinomial is fitted on at most (a documented bound: smallest hashes first).
TRUSTED_ROWS = 20_000
#: Counts added to every bucket, as a share of the mean count.
SMOOTHING = 0.02
#: Score, in nats an n-gram, below which a document is rejected.
THRESHOLD = -0.25
#: Scores are sums of whole millionths, so that they don't depend on the order of addition.
SCALE = 1_000_000

SYMBOLS = "[#*$%&|<>]+"
#: Tokens of the n-grams: runs of letters, marks and digits, and runs of other visible characters.
TOKENS = r"[\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}\x20\x09-\x0D]+"


def _repeated(hashes: Column) -> Column:
    """Number of words in windows of eight that are there twice or more, from the hashes of all words.

    Windows are compared by 64-bit hashes, made by doubling: of two words, of four, of eight. Only where some window
    is there twice are they sorted with their places: those that equal a neighbour are repeated, and what they cover
    is the sum of gaps between them, eight at most.
    """
    paired = lambda reach: lambda h: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + reach)))
    nothing, zero = F.array().cast("array<bigint>"), F.lit(0).cast("long")
    eights = let(let(let(hashes, paired(1)), paired(2)), lambda h: F.transform(F.slice(h, 1, F.greatest(F.size(h) - 7, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 4))))
    suspect = let(eights, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), h).otherwise(nothing))
    ordered = F.sort_array(F.transform(suspect, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    same = lambda w, j, x: F.coalesce(F.get(w, j)["h"] == x["h"], F.lit(False))
    again = F.sort_array(let(ordered, lambda w: F.transform(F.filter(w, lambda x, j: same(w, j - 1, x) | same(w, j + 1, x)), lambda x: x["i"])))
    gaps = let(again, lambda v: F.transform(v, lambda x, j: F.least(F.lit(8), F.coalesce(F.get(v, j + 1) - x, F.lit(8))).cast("long")))
    return F.aggregate(gaps, zero, lambda total, x: total + x)


def base_rules(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(*keep, text.alias("text")).withColumn("words", F.array_remove(F.split("text", SPACE, -1), ""))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = (
        df.withColumn("n_words", F.size("words").cast("long"))
        .withColumn("word_chars", F.char_length(F.array_join("words", "")).cast("long"))
        .withColumn("n_symbols", (F.char_length("text") - F.char_length(F.regexp_replace("text", SYMBOLS, ""))).cast("long"))
        .withColumn("lines", lines)
        .withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    )
    df = df.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).withColumn("n_repeat_words", _repeated(F.col("h")))
    return df.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def _grams(df: DataFrame, n: int) -> DataFrame:
    """Adds grams: array of bucket numbers."""
    hashes = F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(TOKENS), F.lit(0)), lambda w: F.xxhash64(w))
    bucket = lambda x: F.pmod(x, F.lit(n)).cast("int")
    follows = lambda h: F.transform(h, lambda x, i: F.when(i == 0, -1).otherwise(bucket(F.xxhash64(F.get(h, i - 1), x))))
    return df.withColumn("grams", let(hashes, lambda h: F.concat(F.transform(h, bucket), follows(h))))


def log_ratios(docs: DataFrame, trusted: DataFrame, n: int = BUCKETS, most: int = TRUSTED_ROWS, smoothing: float = SMOOTHING) -> list[int]:
    """For each bucket, the log of its share in trusted documents over its share in all, in millionths.

    trusted: a column doc_id. Counts of the whole corpus are partial sums before the shuffle; the two tables that
    reach the driver have n rows.
    """
    ids = trusted.where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).withColumn("good", F.lit(1))
    df = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left")  # at most `most` ids
    counted = _grams(df, n).select(F.coalesce("good", F.lit(0)).alias("good"), F.explode_outer("grams").alias("g")).where("g >= 0")  # not explode: its inferred filter would build the grams twice
    counts = counted.groupBy("g").agg(F.count("*").alias("raw"), F.sum("good").alias("good"))
    rows = {r.g: (r.raw, r.good) for r in counts.collect()}
    return _ratios(rows, n, smoothing)


def _ratios(rows: dict[int, tuple[int, int]], n: int, smoothing: float) -> list[int]:
    raw_all, good_all = sum(r for r, _ in rows.values()), sum(g for _, g in rows.values())
    if not raw_all or not good_all:
        return [0] * n  # nothing to compare: every document scores 0
    more_r, more_g = max(smoothing * raw_all / n, 1e-9), max(smoothing * good_all / n, 1e-9)
    out = []
    for g in range(n):
        r, t = rows.get(g, (0, 0))
        out.append(round(SCALE * (math.log((t + more_g) / (good_all + n * more_g)) - math.log((r + more_r) / (raw_all + n * more_r)))))
    return out


def quality(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, n: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score for every row.

    A document is kept if no base rule fails and its mean log ratio is at least `threshold`. Texts of any length
    are judged whole. Null texts count as empty: they fail the word rule and score 0. Repeated rows are judged each; without trusted rows every score is
    0; an empty table gives no row; columns besides doc_id and text are not looked at.
    """
    ratios = log_ratios(docs, trusted, n)
    table_of = F.expr(f"split('{','.join(map(str, ratios))}', ',')").cast("array<bigint>")  # folded to one constant
    df = base_rules(docs, ["doc_id"])
    df = _grams(df, n)
    total = F.aggregate("grams", F.lit(0).cast("long"), lambda a, g: a + F.coalesce(F.get(table_of, g), F.lit(0).cast("long")))
    count = F.greatest(F.size("grams") - 1, F.lit(1))
    df = df.withColumn("score", total / count / F.lit(float(SCALE)))
    kept = ~F.col("base_failed") & (F.col("score") >= threshold)
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "score")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return quality(table(spark, sf_dir, "documents"), labels.where("quality = 1").select("doc_id"))
