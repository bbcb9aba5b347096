"""A stream of rows into a versioned dataset: each micro-batch merges the keys that it brings, in the partitions that they lie in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.changes import Limits
from ..sources.release import Releases

#: The field of `spread`.
PART = "_part"


def latest(rows: DataFrame, keys: Sequence[str], order: str | Sequence[str]) -> DataFrame:
    """The last row of each key; a null comes first in the order, and null keys are one key."""
    by = [F.col(f"`{c}`").desc_nulls_last() for c in ([order] if isinstance(order, str) else order)]
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*[f"`{k}`" for k in keys]).orderBy(*by))).where("_r = 1").drop("_r")


def spread(rows: DataFrame, keys: Sequence[str], parts: int, name: str = PART) -> DataFrame:
    """The rows with a partition made of their key: a key never changes its partition, and `parts` partitions are alike in size."""
    return rows.withColumn(name, F.pmod(F.xxhash64(*[f"`{k}`" for k in keys]), F.lit(parts)).cast("int"))


def beside(live: DataFrame, rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The live rows in the partitions that other rows touch; the scan is pruned to them.

    Each field's touched values come to the driver, at most a line a partition, like the dataset's layout.
    """
    touched = rows.select(*[f"`{f}`" for f in fields]).distinct().collect()
    for f in fields:
        live = live.where(F.col(f"`{f}`").isin(sorted({r[f] for r in touched if r[f] is not None})))
    if len(fields) > 1:  # one of them alone is told by its values
        parts = live.sparkSession.createDataFrame(touched, rows.select(*[f"`{f}`" for f in fields]).schema)
        live = live.join(F.broadcast(parts), list(fields), "left_semi").select(*[f"`{c}`" for c in live.columns])
    return live


def publishing(stream: DataFrame, releases: Releases, dataset: str, keys: Sequence[str], order: str | Sequence[str], limits: Limits = Limits(), by: Sequence[str] = ()) -> DataStreamWriter:
    """A writer that merges each micro-batch into the live version and publishes the result, guarded like any other.

    Of the rows of a key, live or new, the last in `order` stays, so a late row does not replace a newer one and a batch that
    comes again changes nothing; of equal ones the new one stays.  A deletion is a row that says so in a field of its own: it
    stays, so that no late row brings its key back, and readers leave it out.

    by: fields of the key that partition the dataset (`spread` makes one of any key).  Only the partitions that a batch touches
    are read, merged and written.  Without it the whole dataset is written for each batch, so its trigger should be seldom.

    A publication by someone else between the reading and the writing of a batch is refused as LIVE_CHANGED and ends the
    stream; started again, it merges the batch with what is live then.
    """
    if not set(by) <= set(keys):
        raise ValueError("the fields of the partitions must belong to the key, or a key could change its partition unseen")
    ranked = ["_new"] if not order else [*([order] if isinstance(order, str) else order), "_new"]

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.persist()  # read for the partitions it touches and for the merge
        try:
            if rows.isEmpty():
                return
            now = releases.manifest()
            version = now["live"].get(dataset)
            new = rows.withColumn("_new", F.lit(1))
            if version is not None:
                live = releases.read(dataset, version)
                live = beside(live, rows, by) if by else live
                new = new.unionByName(live.withColumn("_new", F.lit(0)))
            merged = latest(new, keys, ranked).drop("_new")
            releases.publish({dataset: merged}, {dataset: keys}, limits, partitions={dataset: by} if by else None, expected=now["id"], note=f"batch {number}")
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(batch)
