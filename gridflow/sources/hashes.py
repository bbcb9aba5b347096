"""Hashes of a version's rows by key, kept beside it.

The hashes are bucketed and sorted by the normalised key, as many buckets as the session has shuffle partitions when the first
version is written, so two versions are compared bucket by bucket without an exchange, and repeated keys are counted without
one.  Rows themselves are read only where keys differ.  A table's description is a small file, from which any session can name
the table again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import key_columns
from ..operators.changes import row_hash

#: Differing keys that are broadcast to rows at most; more are compared row by row.
FEW = 200_000
NULL = "\u0000null"


@dataclass(frozen=True)
class Hashes:
    """table: names and h; about: keys, fields with types, buckets."""

    table: DataFrame
    names: list[str]
    about: dict


def keyed_by(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The rows with their normalised keys, in which a null part is a text of its own."""
    own, names = key_columns(df, list(keys), "_k")
    return own.withColumns({n: F.coalesce(F.col(n), F.lit(NULL)) for n in names}), names


def write(df: DataFrame, keys: Sequence[str], path: str) -> Hashes:
    """Hash the rows and keep the hashes under a path."""
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own, names = keyed_by(df, keys)
    rows = own.select(*names, F.unhex(row_hash(df)).alias("h")).repartition(buckets, *names)
    rows.write.bucketBy(buckets, *names).sortBy(*names).option("path", f"{path}/rows").saveAsTable(_name(path))
    about = {"keys": list(keys), "fields": sorted([f.name, f.dataType.simpleString()] for f in df.schema), "buckets": buckets}
    spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.text(f"{path}/about")
    return Hashes(spark.table(_name(path)), names, about)


def read(spark: SparkSession, path: str) -> Hashes | None:
    """The hashes under a path; None if there are none."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/about/_SUCCESS")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return None
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    names = [f"_k{i}" for i in range(len(about["keys"]))]
    if not spark.catalog.tableExists(_name(path)):
        by = ", ".join(names)
        columns = ", ".join(f"{n} STRING" for n in names)
        spark.sql(f"CREATE TABLE {_name(path)} ({columns}, h BINARY) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {about['buckets']} BUCKETS LOCATION '{path}/rows'")
    return Hashes(spark.table(_name(path)), names, about)


def _name(path: str) -> str:
    return "hashes_" + uuid.uuid5(uuid.NAMESPACE_URL, path).hex


def keys(one: Hashes) -> list[str]:
    return one.about["keys"]


def fit(one: Hashes, other: Hashes) -> bool:
    """Whether equal hashes mean equal rows: the same keys, fields and types."""
    return one.about["keys"] == other.about["keys"] and one.about["fields"] == other.about["fields"]


def changed(before: Hashes, after: Hashes) -> DataFrame:
    """op (c, u, d) and the normalised key of each row that differs."""
    names = before.names
    both = before.table.withColumnRenamed("h", "hb").join(after.table.withColumnRenamed("h", "ha"), names, "full")
    op = F.when(F.col("hb").isNull(), "c").when(F.col("ha").isNull(), "d").when(F.col("hb") != F.col("ha"), "u")
    return both.withColumn("op", op).where("op is not null").select("op", *names)


def repeated(one: Hashes) -> int:
    """Rows beyond the first of their key."""
    again = one.table.groupBy(*one.names).agg((F.count("*") - 1).alias("n")).where("n > 0")
    return again.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def having(df: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows whose key is among a counted few."""
    own, names = keyed_by(df, keys)
    return own.join(F.broadcast(found.select(*names).distinct()), names, "left_semi").select(*[f"`{c}`" for c in df.columns])
