"""Notebook files as documents: whole files, or their cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from karst.functions.text import strip

CELLS = "cells array<struct<cell_type: string, source: array<string>>>"
CELLS_ONE_TEXT = "cells array<struct<cell_type: string, source: string>>"


def cells_of(text: Column) -> Column:
    """Cells of a notebook's JSON; a source is a list of lines or one text. Null if it is no notebook."""
    listed = F.from_json(text, CELLS)["cells"]
    plain = F.transform(F.from_json(text, CELLS_ONE_TEXT)["cells"], lambda c: F.struct(c["cell_type"].alias("cell_type"), c["source"].alias("source")))
    joined = F.transform(listed, lambda c: F.struct(c["cell_type"].alias("cell_type"), F.array_join(c["source"], "").alias("source")))
    return F.transform(F.arrays_zip(joined.alias("a"), plain.alias("b")), lambda x: F.struct(x["a"]["cell_type"].alias("cell_type"), F.when(x["a"]["source"].isNotNull(), x["a"]["source"]).otherwise(x["b"]["source"]).alias("source")))


def read_files(spark: SparkSession, folder: str, suffix: str = ".ipynb", recursive: bool = False) -> DataFrame:
    """(path, file, text) of the files in a folder whose name ends in suffix."""
    raw = spark.read.option("wholetext", True).option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", recursive).text(folder)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))


def notebook_cells(files: DataFrame, kinds: tuple[str, ...] = ("markdown", "code")) -> DataFrame:
    """A document a cell: page_content (stripped) and metadata (source, cell_index, cell_type); blank cells and other
    kinds are left out."""
    found = files.select("path", "file", F.posexplode(cells_of(F.col("text"))).alias("cell_index", "cell"))
    found = found.withColumn("page_content", strip(F.col("cell.source"))).where(F.col("cell.cell_type").isin(*kinds) & (F.col("page_content") != ""))
    metadata = F.create_map(F.lit("source"), F.col("file"), F.lit("cell_index"), F.col("cell_index").cast("string"), F.lit("cell_type"), F.col("cell.cell_type"))
    return found.select("path", "cell_index", "page_content", metadata.alias("metadata"))


def notebook_documents(files: DataFrame) -> DataFrame:
    """A document a file: its cells' sources in order, each under its kind."""
    body = F.array_join(F.transform(cells_of(F.col("text")), lambda c: F.concat(F.lit("'"), c["cell_type"], F.lit("' cell: "), c["source"])), "\n\n")
    return files.select("path", body.alias("page_content"), F.create_map(F.lit("source"), F.col("path")).alias("metadata")).where("page_content is not null")


def load_documents(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = (".ipynb",), recursive: bool = False) -> DataFrame:
    """All notebooks of a folder, one set of files for each suffix."""
    parts = [notebook_documents(read_files(spark, folder, s, recursive)) for s in suffixes]
    return reduce(DataFrame.unionByName, parts)
