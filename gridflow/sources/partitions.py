"""Versions of a dataset by partition.

A partitioned version is a layout: which publication wrote the folder of each partition.  A publication writes only the
partitions that its rows touch, in a folder of its own; the next layout points to them, and to the folders of older
publications for the rest.  Nothing that is live is written over, and undoing is pointing back.  Readers get the fields of the
partitions from the folders' names, so Spark prunes by them.

A layout is read by the driver; it has a line a partition, as Spark's own list of files has one a file.
"""

from __future__ import annotations

import json
from collections.abc import Collection
from dataclasses import asdict, dataclass, field
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: The folder of a publication's partitions is this name, an equals sign and the version.
RELEASE = "_release"


@dataclass(frozen=True)
class Layout:
    """fields: by which the dataset is partitioned; schema: as JSON; folders: by partition (`a=1/b=2`) the version that wrote it;
    own: the partitions that this version replaced; rows and total: count and checksum of the whole version."""

    fields: tuple[str, ...]
    schema: str
    folders: dict[str, str] = field(default_factory=dict)
    own: tuple[str, ...] = ()
    rows: int = 0
    total: str = "0"

    def text(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def of(text: str) -> Layout:
        made = json.loads(text)
        return Layout(**made | {"fields": tuple(made["fields"]), "own": tuple(made["own"])})

    def with_sums(self, minus: tuple[int, Decimal], plus: tuple[int, Decimal]) -> Layout:
        """The layout with its count and checksum moved by what was replaced: both are sums over rows."""
        rows, total = self.rows - minus[0] + plus[0], Decimal(self.total) - minus[1] + plus[1]
        return Layout(self.fields, self.schema, self.folders, self.own, rows, str(int(total)))


def write(df: DataFrame, base: str, version: str, fields: Collection[str]) -> None:
    """The rows in a folder for each of their partitions; the rows of one partition are several tasks' work where they are many."""
    df.hint("rebalance", *fields).write.partitionBy(*fields).parquet(f"{base}/{RELEASE}={version}")


def written(fs, path, depth: int) -> list[str]:
    """The partition folders below a publication's folder."""
    found = [(path, "")]
    for _ in range(depth):
        found = [(s.getPath(), f"{name}/{s.getPath().getName()}".lstrip("/")) for p, name in found for s in fs.listStatus(p) if s.isDirectory() and "=" in s.getPath().getName()]
    return sorted(name for _, name in found)


def read(spark: SparkSession, base: str, layout: Layout, only: Collection[str] | None = None) -> DataFrame:
    """The rows of a layout, or of some of its partitions."""
    schema = T.StructType.fromJson(json.loads(layout.schema))
    paths = [f"{base}/{RELEASE}={v}/{p}" for p, v in layout.folders.items() if only is None or p in only]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", base).parquet(*paths).select(*[f"`{c}`" for c in schema.names])
