"""What the training-data operators share: reading tables, written intermediate tables, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words in every contract: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset a temporary one is set, in local mode alone: on a
    cluster that would be a folder each machine has for itself, and is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = f"file://{tempfile.mkdtemp(prefix='karst-')}"
        spark.sparkContext.setCheckpointDir(where)
    return where


class Workspace:
    """Intermediate tables of one operator call, written to the shared folder so that no lost executor loses them."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        self.made = 0

    def keep(self, df: DataFrame, label: str = "t") -> DataFrame:
        """Write df and return it as read back: lineage is cut and the rows are fixed."""
        self.made += 1
        path = f"{self.root}/{self.made:03d}-{label}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._karst_path = path
        return out

    def remove(self) -> None:
        """Delete all tables: for callers whose result has been written elsewhere. Until then the result reads them."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def drop(self, df: DataFrame | None) -> None:
        """Delete a table that nothing reads any more."""
        path = getattr(df, "_karst_path", None)
        if path:
            jvm = self.spark._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def shuffle_parts(spark: SparkSession, rows: int, rows_each: int) -> int:
    """Partitions for so many rows, never fewer than the session asks for."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_each))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used and wherever the optimiser moves the expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, kind: str, combine: Callable[[Column, Column], Column]) -> Column:
    """Array of running totals: combine(x, total before x), the latter null at first. Pieces of the root of the length
    keep the work below the square of it."""
    none = F.array().cast(f"array<{kind}>")
    last = lambda a: F.get(a, F.size(a) - 1)

    def pieces(v: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(v))).cast("int")
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / size).cast("int")), lambda j: F.slice(v, j * size + 1, size))
        inner = F.transform(cut, lambda c: F.aggregate(c, none, lambda out, x: F.concat(out, F.array(combine(x, last(out))))))
        shift = lambda parts: F.aggregate(parts, none, lambda out, c: F.concat(out, F.array(combine(last(c), last(out)))))
        return let(inner, lambda parts: let(shift(parts), lambda s: F.flatten(F.transform(parts, lambda c, j: F.transform(c, lambda x: combine(x, F.get(s, j - 1)))))))

    return let(values, lambda v: F.when(F.size(v) > 0, pieces(v)).otherwise(none))


def components(work: Workspace, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id in edges; component is the smallest id reachable.

    Minimum labels travel along edges and then jump to the label's own label, so the rounds grow with the
    logarithm of a component's width, not with its size. Sums of hot ids are partial; the joins are plain equi-joins
    of two exchanges, which adaptive execution splits when a key is hot.
    """
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(edges.select(F.col(b).alias("x"), F.col(a).alias("y")))
    both = work.keep(both.where("x <> y").distinct(), "links")
    label = work.keep(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("id"), F.least("x", "m").alias("component")), "labels")
    while True:
        near = both.join(label.select(F.col("id").alias("y"), "component"), "y").groupBy("x").agg(F.min("component").alias("m"))
        step = label.join(near, label.id == near.x).select("id", F.col("component").alias("was"), F.least("component", "m").alias("component"))
        root = label.select(F.col("id").alias("r"), F.col("component").alias("up"))
        step = step.join(root, step.component == root.r, "left").select("id", "was", F.least("component", F.coalesce("up", "component")).alias("component"))
        step = work.keep(step, "labels")
        changed = not step.where("component <> was").isEmpty()
        work.drop(label)
        label = step.drop("was")
        label._karst_path = step._karst_path
        if not changed:
            work.drop(both)
            return label
