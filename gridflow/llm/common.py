"""Helpers shared by the operators: shared-folder tables, packed words, linked components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whitespace of the token contracts: U+0020 and U+0009 to U+000D.  bytes.split() uses the same set.
ASCII_SPACE = b" \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where it is unset, and only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def bounded_batches(spark: SparkSession, rows: int = 1000, size: str = "16m") -> None:
    """Arrow batches of fewer rows and bytes than Spark's defaults, so that a Python worker holds little text at once.

    A setting that the session has changed itself stays.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b":
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage is cut and lost executors cost no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_fold(column: Column | str, folds: int) -> Column:
    """crc32 of a column's text, modulo `folds`; a null is hashed as the empty text."""
    text = (F.col(column) if isinstance(column, str) else column).cast("string")
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary")) % folds


def text_bytes(text) -> bytes:
    """UTF-8 of a text with A-Z lower-cased; null is empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass").lower()


def chunks(batches: Iterator, weight: int, column: str = "text") -> Iterator:
    """Cut the pandas batches of a partition into slices of about `weight` characters (one row at least)."""
    for pdf in batches:
        size = pdf[column].str.len().fillna(0).to_numpy(dtype=np.int64)
        group = (np.cumsum(size) - size) // weight
        cuts = np.flatnonzero(np.diff(group, prepend=-1))
        for a, b in pairwise([*cuts, len(pdf)]):
            yield pdf.iloc[a:b].reset_index(drop=True)


def arrow_chunks(batches: Iterator[pa.RecordBatch], weight: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same for Arrow batches, by bytes."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = (np.cumsum(size) - size) // weight
        cuts = np.flatnonzero(np.diff(group, prepend=-1))
        for a, b in pairwise([*cuts, len(size)]):
            yield batch.slice(a, b - a)


def hook(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Union u[i] with v[i] in a parent array whose entries are roots; afterwards they are roots again."""
    while True:
        pu, pv = parent[u], parent[v]
        open_ = pu != pv
        if not open_.any():
            return
        u, v, pu, pv = u[open_], v[open_], pu[open_], pv[open_]
        np.minimum.at(parent, np.maximum(pu, pv), np.minimum(pu, pv))
        while not np.array_equal(up := parent[parent], parent):
            parent[:] = up


def components(links: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """(node, root): the smallest node that each linked node reaches.

    Each round points every node at the smallest root in its neighbourhood and then jumps pointers; links become
    links between roots, so their number falls geometrically.  Rounds are cut with written tables.  Nodes without a
    link do not appear.
    """
    edges = materialise(links.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a <> b").distinct(), "edges")
    nodes = materialise(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node")), "roots")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a")).toDF("n", "m")
        least = both.groupBy("n").agg(F.min("m").alias("m")).select("n", F.least("n", "m").alias("up"))
        least = materialise(least, "up")
        # pointer jumping until every pointer of this round is a root
        while True:
            above = least.select(F.col("n").alias("up"), F.col("up").alias("upper"))
            jumped = materialise(least.join(above, "up", "left").select("n", F.coalesce("upper", "up").alias("up2"), "up"), "up")
            moved = not jumped.where("up <> up2").isEmpty()
            least = jumped.select("n", F.col("up2").alias("up"))
            if not moved:
                break
        nodes = materialise(nodes.join(least.withColumnsRenamed({"n": "root"}), "root", "left").select("node", F.coalesce("up", "root").alias("root")), "roots")
        to = least
        edges = materialise(
            edges.join(to.select(F.col("n").alias("a"), F.col("up").alias("ra")), "a")
            .join(to.select(F.col("n").alias("b"), F.col("up").alias("rb")), "b")
            .where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(),
            "edges",
        )
    return nodes
