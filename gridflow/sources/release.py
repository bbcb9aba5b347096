"""Versioned datasets: each publication is a folder of Parquet, and one small manifest names the live one.

A publication is written beside the live version, counted, and made live by replacing the manifest.  Rolling back is
pointing to an older version.  A dataset that is published by partitions is kept by partitions (see `partitions`): only those
that a publication touches are read, compared and written.  Beside a version that has a key lie its hashes (see `hashes`).  All paths go through Spark's Hadoop file system, so any store that Spark reads will do.

Two publications at once: the second to write the next manifest is refused, since a file is created without overwriting.
HDFS and local file systems do that in one step; on an object store without such a step the writers need a lock of their
own.  A refused publication deletes what it has written.
"""

from __future__ import annotations

import dataclasses
import json
import time
import uuid
from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import changes
from . import hashes, partitions
from .partitions import Layout


class ReleaseError(RuntimeError):
    """A publication that was refused; nothing live has changed."""


class Releases:
    """The versions of one or more datasets under a root folder; datasets of one publication go live together."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self.jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *names: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join((self.root, *names)))

    def _text(self, name: str) -> str | None:
        path = self._path(name)
        if not self.fs.exists(path):
            return None
        stream = self.fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def manifest(self) -> dict:
        """id of the live publication, version of each dataset, and the history of publications, oldest first."""
        names = sorted(s.getPath().getName() for s in self.fs.listStatus(self._path())) if self.fs.exists(self._path()) else []
        own = [n for n in names if n.startswith("manifest-") and n.endswith(".json")]
        return json.loads(self._text(own[-1])) if own else {"id": 0, "live": {}, "history": []}

    def _commit(self, expected: int, live: Mapping[str, str], note: str, **more: object) -> dict:
        """The next manifest; creating its file without overwriting is the compare-and-set.  more: what its entry says besides."""
        now = self.manifest()
        if now["id"] != expected:
            raise ReleaseError(f"LIVE_CHANGED: {expected} is no longer live")
        new = {"id": expected + 1, "live": dict(live), "history": [*now["history"], {"id": expected + 1, "live": dict(live), "note": note, "at": time.time(), **more}]}
        try:
            stream = self.fs.create(self._path(f"manifest-{new['id']:012d}.json"), False)
        except Exception as e:
            raise ReleaseError("LIVE_CHANGED: another publication came first") from e
        try:
            stream.write(bytearray(json.dumps(new).encode()))
            stream.close()
        except Exception:  # the file is ours and names versions that are about to go
            self.fs.delete(self._path(f"manifest-{new['id']:012d}.json"), False)
            raise
        return new

    def _layout(self, dataset: str, version: str | None) -> Layout | None:
        """How a version is partitioned; None if it is not."""
        text = self._text(f"_layouts/{dataset}/{version}.json") if version else None
        return Layout.of(text) if text else None

    def _keep(self, dataset: str, version: str, layout: Layout) -> None:
        stream = self.fs.create(self._path("_layouts", dataset, f"{version}.json"), False)
        stream.write(bytearray(layout.text().encode()))
        stream.close()

    def read(self, dataset: str, version: str | None = None) -> DataFrame | None:
        """The live rows of a dataset, or those of a version; None if there are none yet."""
        own = version or self.manifest()["live"].get(dataset)
        if own is None:
            return None
        layout = self._layout(dataset, own)
        return self.spark.read.parquet(f"{self.root}/{dataset}/{own}") if layout is None else partitions.read(self.spark, f"{self.root}/{dataset}", layout)

    def _sum(self, df: DataFrame) -> list[str]:
        return [str(x) for x in self._sums(df)]

    def _sums(self, df: DataFrame) -> tuple[int, Decimal]:
        return tuple(changes.checksum(df.select(*[f"`{c}`" for c in sorted(df.columns)])).first())

    def drifted(self, dataset: str) -> bool:
        """Whether the live rows are no longer those that were published."""
        now = self.manifest()
        version = now["live"].get(dataset)
        noted = next((h["sums"][dataset] for h in reversed(now["history"]) if h["live"].get(dataset) == version and dataset in h.get("sums", {})), None)
        return noted is not None and self._sum(self.read(dataset, version)) != noted

    def publish(
        self, outputs: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]], limits: changes.Limits = changes.Limits(), force: bool = False, partitions: Mapping[str, Sequence[str]] | None = None, errors: int = 0,
        targets: Mapping[str, T.StructType] | None = None, lengths: Mapping[str, Mapping[str, int]] | None = None, drift: str = "OVERWRITE", note: str = "publish", expected: int | None = None,
    ) -> dict:
        """Write, check and make live; the counts of changes by dataset, and the manifest.

        A dataset named in `partitions` replaces only the partitions that its rows touch.  targets: the schema that a
        dataset must fit in names, types and values (guards SCHEMA and VALUES, as for repeated keys); drift REJECT refuses
        live rows that someone else has changed, but for partitions.  expected: the publication that the rows were made from.
        """
        start = self.manifest()
        if expected is not None and start["id"] != expected:
            raise ReleaseError(f"LIVE_CHANGED: {expected} is no longer live")
        live, report, sums, written, kept = dict(start["live"]), {}, {}, [], {}
        try:
            for name, df in outputs.items():
                version, fields, key = uuid.uuid4().hex, (partitions or {}).get(name), keys.get(name)
                target = (targets or {}).get(name)
                wrong = changes.schema_problems(df, target) if target is not None else []
                if wrong:
                    raise ReleaseError(f"GUARDS: {name}: SCHEMA: {'; '.join(wrong)}")
                make = self._partitioned if fields else self._whole
                rows, n, counts, again, sums[name] = make(name, version, df, live.get(name), key, fields, written)
                # what was written is checked, so that the rows are made once
                bad = changes.bad_values(self._fresh(name, version), target, (lengths or {}).get(name)).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"] if target is not None else 0
                moved = drift == "REJECT" and not fields and name in live and self.drifted(name)
                failed = changes.guards(rows, n, **counts, limits=limits, errors=errors, bad_values=bad + again, drift=moved)
                if [g for g in failed if not force or g in changes.NEVER_FORCED]:
                    raise ReleaseError(f"GUARDS: {name}: {', '.join(failed)}")
                if fields:
                    kept[name] = {"fields": list(fields), "before": live.get(name)}
                live[name], report[name] = version, counts
            return {"changes": report, "manifest": self._commit(start["id"], live, note, sums=sums, partitions=kept)}
        except Exception:
            named = {v for h in self.manifest()["history"] for v in h["live"].values()}
            for path in written:
                if not any(v in path for v in named):
                    self.fs.delete(self._path(path), True)
            raise

    def _fresh(self, dataset: str, version: str) -> DataFrame:
        """The rows that a version wrote itself."""
        layout = self._layout(dataset, version)
        return self.read(dataset, version) if layout is None else partitions.read(self.spark, f"{self.root}/{dataset}", layout, set(layout.own))

    def _whole(self, name: str, version: str, df: DataFrame, live: str | None, key: Sequence[str] | None, fields: None, written: list[str]) -> tuple:
        """Write all rows; live rows, new rows, counts of changes, rows beyond the first of their key, and sums."""
        written.append(f"{name}/{version}")
        df.write.parquet(f"{self.root}/{name}/{version}")
        new, before = self.read(name, version), self.read(name, live)
        n, total = self._sums(new)
        again = 0
        if key:
            written.append(f"_hashes/{name}/{version}")
            mine = hashes.write(new, key, f"{self.root}/_hashes/{name}/{version}")
            again = hashes.repeated(mine)
        if before is None:
            return 0, n, {"created": n, "updated": 0, "deleted": 0}, again, [str(n), str(total)]
        theirs = hashes.read(self.spark, f"{self.root}/_hashes/{name}/{live}") if key else None
        if theirs is not None and hashes.fit(theirs, mine):
            found = hashes.changed(theirs, mine)
        else:
            found = changes.keyed(before, new, key) if key else changes.keyless(before, new)
        return before.count(), n, changes.summary(found).first().asDict(), again, [str(n), str(total)]

    def _partitioned(self, name: str, version: str, df: DataFrame, live: str | None, key: Sequence[str] | None, fields: Sequence[str], written: list[str]) -> tuple:
        """The same for the partitions that the rows touch; the others are neither read nor written, but for keys that do not hold the partition."""
        base, fields = f"{self.root}/{name}", list(fields)
        void = [F.col(f"`{f}`").isNull() | (F.col(f"`{f}`").cast("string") == "") for f in fields]
        if not df.where(F.exists(F.array(*void), lambda x: x)).isEmpty():
            raise ReleaseError(f"PARTITION_NULL: {name}")
        old = self._layout(name, live)
        if live is not None and old is None:
            old = self._split(name, live, fields)
        if old is None:
            old = Layout(tuple(fields), df.schema.json())
        if list(old.fields) != fields:
            raise ReleaseError(f"PARTITION_FIELDS: {name} is kept by {', '.join(old.fields)}")
        written.append(f"{name}/{partitions.RELEASE}={version}")
        partitions.write(df.select(*[f"`{c}`" for c in T.StructType.fromJson(json.loads(old.schema)).names]), base, version, fields)
        own = partitions.written(self.fs, self._path(name, f"{partitions.RELEASE}={version}"), len(fields))
        layout = dataclasses.replace(old, folders=old.folders | dict.fromkeys(own, version), own=tuple(own))
        before, new = partitions.read(self.spark, base, old, set(own)), partitions.read(self.spark, base, layout, set(own))
        layout = layout.with_sums(self._sums(before), self._sums(new))
        again = 0
        if key:
            again = sum(r["n"] for r in changes.duplicate_keys(new, key).collect())  # one row at most
            if not set(fields) <= set(key):
                others = partitions.read(self.spark, base, old, set(old.folders) - set(own)).select(*key)
                again += changes.sharing_keys(new.select(*key), others, key)
        counts = changes.summary(changes.keyed(before, new, key) if key else changes.keyless(before, new)).first().asDict()
        written.append(f"_layouts/{name}/{version}.json")
        self._keep(name, version, layout)
        return old.rows, layout.rows, counts, again, [str(layout.rows), layout.total]

    def _split(self, name: str, live: str, fields: Sequence[str]) -> Layout:
        """The layout of a version that was written whole: its rows are written once more, by partition."""
        rows, base, version = self.read(name, live), f"{self.root}/{name}", f"{live}-{uuid.uuid4().hex[:8]}"
        partitions.write(rows, base, version, fields)
        own = partitions.written(self.fs, self._path(name, f"{partitions.RELEASE}={version}"), len(fields))
        n, total = self._sums(rows)
        layout = Layout(tuple(fields), rows.schema.json(), dict.fromkeys(own, version), tuple(own), n, str(total))
        self._keep(name, live, layout)
        return layout

    def take_over(self, dataset: str, df: DataFrame) -> dict:
        """The rows that a dataset had before it was published here, as its baseline, which retention never deletes."""
        start = self.manifest()
        if dataset in start["live"]:
            raise ReleaseError(f"TAKEN_OVER: {dataset}")
        version = uuid.uuid4().hex
        df.write.parquet(f"{self.root}/{dataset}/{version}")
        return self._commit(start["id"], start["live"] | {dataset: version}, "baseline", sums={dataset: self._sum(self.read(dataset, version))}, baseline=True)

    def undo_partitions(self, dataset: str, publication: int) -> dict:
        """The partitions that a publication replaced, as they were before it; refused if a later one touched any of them."""
        now = self.manifest()
        own = next((h for h in now["history"] if h["id"] == publication and dataset in h.get("partitions", {})), None)
        if own is None or own["partitions"][dataset]["before"] is None:
            raise ReleaseError(f"NO_PARTITIONS: {publication}")
        then, past, here = (self._layout(dataset, v) for v in (own["live"][dataset], own["partitions"][dataset]["before"], now["live"][dataset]))
        for h in now["history"]:
            if h["id"] > publication and h["live"].get(dataset) != own["live"][dataset]:
                later = self._layout(dataset, h["live"].get(dataset))
                if later is None or later.fields != then.fields or set(later.own) & set(then.own):
                    raise ReleaseError(f"PARTITION_TOUCHED_LATER: by {h['id']}")
        version, base, touched = uuid.uuid4().hex, f"{self.root}/{dataset}", set(then.own)
        folders = {p: v for p, v in here.folders.items() if p not in touched} | {p: past.folders[p] for p in then.own if p in past.folders}
        layout = dataclasses.replace(here, folders=folders, own=then.own)
        layout = layout.with_sums(self._sums(partitions.read(self.spark, base, here, touched)), self._sums(partitions.read(self.spark, base, layout, touched)))
        self._keep(dataset, version, layout)
        return self._commit(now["id"], now["live"] | {dataset: version}, f"undo partitions of {publication}", sums={dataset: [str(layout.rows), layout.total]})

    def forecast(self, dataset: str, df: DataFrame, key: Sequence[str], limits: changes.Limits = changes.Limits()) -> dict:
        """Counts and failing guards of a publication that is not made."""
        before = self.read(dataset)
        if before is None:
            n = df.count()
            return {"created": n, "updated": 0, "deleted": 0, "failed": changes.guards(0, n, n, 0, 0, limits)}
        counts = changes.summary(changes.keyed(before, df, key)).first().asDict()
        return counts | {"failed": changes.guards(before.count(), df.count(), **counts, limits=limits)}

    def preview_roll_back(self, to: int, keys: Mapping[str, Sequence[str]]) -> dict:
        """For each dataset what rolling back would change, fields whose types differ, and whether its live rows have drifted."""
        now = self.manifest()
        past = next((h for h in now["history"] if h["id"] == to), None)
        if past is None:
            raise ReleaseError(f"NO_RELEASE: {to}")
        out = {}
        for name, version in past["live"].items():
            live, old = self.read(name), self.read(name, version)
            both = [c for c in old.columns if c in live.columns]
            found = changes.keyed(live.select(both), old.select(both), keys[name]) if keys.get(name) else changes.keyless(live.select(both), old.select(both))
            out[name] = changes.summary(found).first().asDict() | {"schema": changes.schema_problems(old, live.schema), "drifted": self.drifted(name)}
        return out

    def regress(self, dataset: str, runs: Sequence[tuple[DataFrame, int]], key: Sequence[str]) -> list[dict]:
        """Counts of what a draft's rows change against what was published, for each (rows, publication)."""
        by = {h["id"]: h["live"].get(dataset) for h in self.manifest()["history"]}
        return [{"publication": i} | changes.summary(changes.keyed(self.read(dataset, by[i]), df, key)).first().asDict() for df, i in runs]

    def write_issues(self, issues: DataFrame, name: str = "issues") -> str:
        """Issues as a table of their own beside the datasets."""
        path = f"{self.root}/_{name}/{uuid.uuid4().hex}"
        issues.write.parquet(path)
        return path

    def roll_back(self, to: int, expected: int | None = None, drift: str = "OVERWRITE", same_schema: bool = False) -> dict:
        """Make the versions of an older publication live again; nothing is rewritten.

        drift REJECT refuses live rows that someone else has changed; same_schema refuses versions of another schema (see `rewrite_back`).
        """
        now, past = self._past(to)
        for name, version in past["live"].items():
            if version == now["live"].get(name):
                continue
            if drift == "REJECT" and self.drifted(name):
                raise ReleaseError(f"DRIFT: {name}")
            if same_schema and name in now["live"]:
                wrong = changes.schema_problems(self.read(name, version), self.read(name).schema)
                if wrong:
                    raise ReleaseError(f"SCHEMA: {name}: {'; '.join(wrong)}")
        return self._commit(now["id"] if expected is None else expected, past["live"], f"roll back to {to}")

    def _past(self, to: int) -> tuple[dict, dict]:
        now = self.manifest()
        past = next((h for h in now["history"] if h["id"] == to), None)
        if past is None:
            raise ReleaseError(f"NO_RELEASE: {to}")
        return now, past

    def rewrite_back(self, to: int, expected: int | None = None, defaults: Mapping[str, Mapping[str, object]] | None = None, drift: str = "REJECT", lossy: bool = False) -> dict:
        """The rows of an older publication, written anew in the schema that is live.

        Values are cast to the live types; a field that is new since then takes its default, or null.  Refused are live rows that
        have drifted, a value that a cast would lose, and a field that is no longer there, unless `lossy` says that they may go.
        """
        now, past = self._past(to)
        if expected is not None and now["id"] != expected:
            raise ReleaseError(f"LIVE_CHANGED: {expected} is no longer live")
        live, sums, written = dict(now["live"]), {}, []
        try:
            for name, version in past["live"].items():
                if version == live.get(name):
                    continue
                if name not in live:
                    live[name] = version
                    continue
                if drift == "REJECT" and self.drifted(name):
                    raise ReleaseError(f"DRIFT: {name}")
                old, want = self.read(name, version), self.read(name).schema
                gone = [c for c in old.columns if c not in want.names]
                if gone and not lossy:
                    raise ReleaseError(f"REWRITE_LOSS: {name}: {', '.join(gone)} no longer there")
                made = {f.name: F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in old.columns else F.lit((defaults or {}).get(name, {}).get(f.name)).cast(f.dataType) for f in want}
                if not lossy:
                    both = [f.name for f in want if f.name in old.columns and old.schema[f.name].dataType != f.dataType]
                    # a value is lost where the cast gives null, or another value on the way back
                    lost = [F.count(F.when(F.col(f"`{c}`").isNotNull() & ~F.equal_null(made[c].try_cast(old.schema[c].dataType), F.col(f"`{c}`")), 1)).alias(c) for c in both]
                    found = {c: n for c, n in (old.agg(*lost).first().asDict() if lost else {}).items() if n}
                    if found:
                        raise ReleaseError(f"REWRITE_LOSS: {name}: " + ", ".join(f"{n} values of {c}" for c, n in found.items()))
                fresh = uuid.uuid4().hex
                written.append(f"{name}/{fresh}")
                old.select(*[c.alias(n) for n, c in made.items()]).write.parquet(f"{self.root}/{name}/{fresh}")
                live[name], sums[name] = fresh, self._sum(self.read(name, fresh))
            return self._commit(now["id"], live, f"rewrite back to {to}", sums=sums)
        except Exception:
            named = {v for h in self.manifest()["history"] for v in h["live"].values()}
            for path in written:
                if not any(v in path for v in named):
                    self.fs.delete(self._path(path), True)
            raise

    def changes_between(self, dataset: str, old: int, new: int, key: Sequence[str]) -> DataFrame:
        """The change set of a dataset between two publications, computed when asked for.

        Where both have hashes and few rows differ, the keys that differ come from them, and go to both sides' rows.
        """
        by = {h["id"]: h["live"].get(dataset) for h in self.manifest()["history"]}
        before, after = self.read(dataset, by[old]), self.read(dataset, by[new])
        ours, theirs = (hashes.read(self.spark, f"{self.root}/_hashes/{dataset}/{by[i]}") for i in (old, new))
        if ours is not None and theirs is not None and hashes.fit(ours, theirs) and hashes.keys(ours) == list(key):
            found = hashes.changed(ours, theirs)
            if found.count() <= hashes.FEW:
                return changes.keyed(hashes.having(before, found, key), hashes.having(after, found, key), key)
        return changes.keyed(before, after, key)

    def drop_old(self, keep: int, days: float = 1.0) -> list[str]:
        """Delete versions that none of the newest `keep` publications names, nor the live one, nor a baseline, and that are `days` old.

        The age spares what another publication is writing just now; a partition's folder stays while a layout that is kept names it.
        """
        now = self.manifest()
        held = {(d, v) for h in now["history"] if h in now["history"][-keep:] or h.get("baseline") for d, v in h["live"].items()} | set(now["live"].items())
        before = (time.time() - days * 86_400) * 1000
        gone = []
        for d in {d for h in now["history"] for d in h["live"]}:
            versions = {v for name, v in held if name == d}
            layouts = [x for x in (self._layout(d, v) for v in versions) if x is not None]
            folders = {f"{partitions.RELEASE}={v}" for x in layouts for v in x.folders.values()}
            for place, kept in ((d, versions | folders), (f"_layouts/{d}", {f"{v}.json" for v in versions}), (f"_hashes/{d}", versions)):
                for status in self.fs.listStatus(self._path(place)) if self.fs.exists(self._path(place)) else ():
                    v = status.getPath().getName()
                    if v not in kept and status.getModificationTime() <= before:
                        self.fs.delete(status.getPath(), True)
                        gone.append(f"{place}/{v}")
        return gone
