"""Near duplicates among embeddings, by hashing to the lattice E8.

Vectors of length 1 are turned by random rotations, one for each table.  Some eights of the turned coordinates, widened so
that a pair at the bar is `STEP` apart in each on average and shifted at random, are decoded to their nearest points of E8
(whole or half coordinates of even sum); the points of a table's eights together are the vector's cell.  Of the 240 points
around each decoded one the nearest to the vector are neighbours, and the cheapest combinations of them are probed too.
Two vectors meet where one probes the other's cell or both lie in one, in any table.  With the settings here a pair of cosine
0.98 meets with chance 0.99 (measured, see the README), one that is nearer more surely, and random vectors of 64 dimensions
with chance of some 2.5 in a million.

Vectors that meet are compared, and those that reach the cosine are linked; a cell gives the links of a spanning forest.
The links' connected classes hold every linked pair, so direct links are counted within classes, each pair once.  Equal
vectors of one label are one node with a weight, so copies cost nothing.  Cells and classes are cut into tiles of bounded
size, and a pair of tiles is a task's work; what leaves it is at most a row for each of its vectors.

Defined results: a vector that is null, empty, zero or holds null or non-finite components, or whose label is null, has no
links and is a class of its own; vectors of unequal dimensions never link; rows with one id are vectors of their own; a row
without an id links like any other but names no class, and is not kept; a class none of whose rows has an id has a null id;
an empty table gives none.  Only the id, vector and label columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, product

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, hook, materialise, parts
from .ngrams import mix

#: Tables, eights of coordinates of a cell, probed cells of a table, and the mean distance of a pair at the bar in an eight.
TABLES, EIGHTS, PROBES, STEP, SEED = 4, 3, 6, 0.283, 12
#: Neighbours of a point that are combined with those of the other eights.
NEAREST = 3
#: Vectors of a tile, and of a slice that is compared at once; vectors hashed at once.
TILE, SLICE, HASHED = 4096, 256, 4096
#: The shortest vectors of E8: two coordinates of 1 or -1, or eight halves, an even number of them negative.
ROOTS = np.array(
    [[float(s * (k == i) + t * (k == j)) for k in range(8)] for i, j in combinations(range(8), 2) for s, t in product((1, -1), repeat=2)]
    + [list(h) for h in product((0.5, -0.5), repeat=8) if np.prod(h) > 0]
)
_PAIR = "a long, b long"


def even(y: np.ndarray) -> np.ndarray:
    """The nearest points of whole coordinates and even sum: an odd sum moves the coordinate that was rounded furthest."""
    out = np.rint(y)
    away = y - out
    odd = np.flatnonzero(out.sum(axis=1) % 2)
    far = np.abs(away[odd]).argmax(axis=1)
    out[odd, far] += np.where(away[odd, far] >= 0, 1, -1)
    return out


def decode(y: np.ndarray) -> np.ndarray:
    """The nearest points of E8."""
    whole, half = even(y), even(y - 0.5) + 0.5
    return np.where((((y - whole) ** 2).sum(axis=1) <= ((y - half) ** 2).sum(axis=1))[:, None], whole, half)


class Hashing:
    """Cells of vectors of one dimension."""

    def __init__(self, dim: int, similarity: float) -> None:
        rng = np.random.RandomState(SEED)
        self.width = max(dim, 8)
        self.eights = min(EIGHTS, self.width // 8)
        self.scale = STEP / np.sqrt((2 - 2 * min(similarity, 0.999)) * 8 / self.width)
        self.turns = [np.linalg.qr(rng.normal(size=(self.width, 8 * self.eights)))[0] for _ in range(TABLES)]
        self.shifts = rng.uniform(-1, 1, (TABLES, 8 * self.eights))
        self.odd = (rng.randint(1, 2**62, (TABLES, 8 * self.eights), dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
        self.choices = np.array(list(product(range(NEAREST + 1), repeat=self.eights)))

    def cells(self, x: np.ndarray) -> np.ndarray:
        """uint64 [table, n, 1 + probes]: each vector's own cell, and those that it probes."""
        x = np.pad(x, ((0, 0), (0, self.width - x.shape[1])))
        out = []
        for turn, shift, odd in zip(self.turns, self.shifts, self.odd, strict=True):
            y = self.scale * (x @ turn) + shift
            near, cost = [], []
            for e in range(self.eights):
                own = y[:, 8 * e : 8 * e + 8]
                point = decode(own)
                more = 2 - 2 * (own - point) @ ROOTS.T  # by how much the squared distance grows
                best = np.argpartition(more, NEAREST - 1, axis=1)[:, :NEAREST]
                points = np.concatenate([point[:, None], point[:, None] + ROOTS[best]], axis=1)
                code = ((2 * points).astype(np.int64).astype(np.uint64) * odd[8 * e : 8 * e + 8]).sum(axis=2, dtype=np.uint64)
                near.append(code)
                cost.append(np.concatenate([np.zeros((len(x), 1)), np.take_along_axis(more, best, axis=1)], axis=1))
            total = sum(c[:, self.choices[:, e]] for e, c in enumerate(cost))
            pick = np.argsort(total, axis=1, kind="stable")[:, : PROBES + 1]
            out.append(sum(n[np.arange(len(x))[:, None], self.choices[pick][:, :, e]] for e, n in enumerate(near)))
        return np.stack(out)


def prepared(df: DataFrame, id_column: str, vector: str, label: str) -> DataFrame:
    """id, h (equal for equal vectors of one label; null for rows that take no part), label, v (doubles of length 1)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            hashes, vectors = [], []
            for x, name in zip(pdf["v"], pdf["label"], strict=True):
                own = np.zeros(0) if x is None or name is None else np.asarray(x, np.float64)
                top = np.abs(own).max(initial=0)
                if np.isfinite(top) and top > 0:
                    own = own / top
                    own = own / np.sqrt(own @ own) + 0.0
                    vectors.append(own.astype("<f8").tobytes())
                    hashes.append(xxhash.xxh3_128_digest(vectors[-1] + name.encode("utf-8", "surrogatepass")))
                else:
                    vectors.append(None)
                    hashes.append(None)
            yield pd.DataFrame({"id": pdf["id"].astype("Int64"), "h": hashes, "label": pdf["label"], "v": vectors})

    v = F.transform(F.col(vector), lambda x: F.coalesce(x.cast("double"), F.lit(float("nan"))))
    picked = df.select(F.col(id_column).cast("long").alias("id"), v.alias("v"), F.col(label).cast("string").alias("label"))
    return picked.mapInPandas(run, "id long, h binary, label string, v binary")


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), "<f8").reshape(len(vectors), -1)


def hashed(nodes: DataFrame, similarity: float) -> DataFrame:
    """cell, node, home: the cells of each node in all tables; home: it lies there.

    A cell is told by 64 bits, in which the label and the dimension have a part; only who shares them goes on.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: dict[int, Hashing] = {}
        for pdf in batches:
            for dim, same in pdf.groupby(pdf["v"].str.len() // 8):
                made[dim] = made.get(dim) or Hashing(int(dim), similarity)
                for a in range(0, len(same), HASHED):
                    part = same.iloc[a : a + HASHED]
                    names = np.array([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), int(dim)) for x in part["label"]], np.uint64)
                    for t, own in enumerate(made[dim].cells(matrix(part["v"]))):
                        cells = mix(own + names[:, None] + np.uint64(t * 0x9E3779B97F4A7C15 % 2**64)).astype(np.int64).ravel()
                        width = own.shape[1]
                        yield pd.DataFrame({"cell": cells, "node": np.repeat(part["node"].to_numpy(np.int64), width), "home": np.tile(np.arange(width) == 0, len(part))})

    return nodes.select("node", "label", "v").mapInPandas(run, "cell long, node long, home boolean")


def all_pairs(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows i < j of each of the groups that follow each other with these sizes."""
    row = np.arange(size.sum())
    ends = np.repeat(np.cumsum(size), size)
    after = ends - row - 1
    i = np.repeat(row, after)
    return i, i + 1 + np.arange(after.sum()) - np.repeat(np.cumsum(after) - after, after)


def like(x: np.ndarray, size: np.ndarray, first: np.ndarray, home: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows within groups that reach the cosine, of which one is at home, and in a group of two tiles one is of each.

    first: 1 for the rows of a group's first tile, 0 for those of its second, -1 where the group is one tile.
    """
    starts = np.cumsum(size) - size
    small = np.flatnonzero((size <= 64) & (size > 1))
    work = np.cumsum(size[small] ** 2) // 100_000
    for part in np.split(small, np.flatnonzero(np.diff(work)) + 1):
        if len(part):
            rows = np.repeat(starts[part], size[part]) + np.arange(size[part].sum()) - np.repeat(np.cumsum(size[part]) - size[part], size[part])
            i, j = (rows[k] for k in all_pairs(size[part]))
            fits = (home[i] | home[j]) & ((first[i] < 0) | (first[i] != first[j]))
            i, j = i[fits], j[fits]
            near = np.einsum("ij,ij->i", x[i], x[j]) >= similarity
            yield i[near], j[near]
    for g in np.flatnonzero(size > 64):
        rows = np.arange(starts[g], starts[g] + size[g])
        left, right = (rows, rows) if first[rows[0]] < 0 else (rows[first[rows] == 1], rows[first[rows] == 0])
        for a in range(0, len(left), SLICE):
            own = left[a : a + SLICE]
            near = (x[own] @ x[right].T >= similarity) & (home[own][:, None] | home[right])
            i, j = np.nonzero(near)
            i, j = own[i], right[j]
            once = i < j if first[rows[0]] < 0 else slice(None)
            yield i[once], j[once]


def tiled(rows: DataFrame, key: list[str]) -> DataFrame:
    """The rows of each group, cut into tiles of bounded size and dealt to the pairs (i, j) of its tiles, group by group.

    A group of one tile is one pair; `first` tells the tiles of a pair apart.
    """
    tiles = rows.groupBy(*key).agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    dealt = rows.join(tiles, key).withColumn("tile", F.pmod(F.xxhash64("node"), "tiles").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    i, j = F.least("tile", "other"), F.greatest("tile", "other")
    dealt = dealt.withColumns({"i": i, "j": j, "first": F.when(i == j, -1).when(F.col("tile") == i, 1).otherwise(0)}).drop("tile", "other", "tiles")
    return dealt.repartition(parts(rows.sparkSession), *key, "i", "j").sortWithinPartitions(*key, "i", "j")


def compared(dealt: DataFrame, key: list[str], of: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """What `of` makes of whole groups of sorted rows, and of their sizes."""
    key = [*key, "i", "j"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            new = np.flatnonzero(np.append(True, (pdf[key].to_numpy()[1:] != pdf[key].to_numpy()[:-1]).any(axis=1)))
            held = pdf.iloc[new[-1] :]
            if new[-1]:
                yield of(pdf.iloc[: new[-1]], np.diff(new))
        if held is not None and len(held):
            yield of(held.reset_index(drop=True), np.array([len(held)]))

    return dealt.mapInPandas(run, schema)


def by_dim(pdf: pd.DataFrame, size: np.ndarray) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """The groups of each dimension, which is one within a group."""
    dims = pdf["v"].str.len().to_numpy()
    of_group = dims[np.cumsum(size) - size]
    for d in np.unique(of_group):
        yield pdf[dims == d], size[of_group == d]


def links(nodes: DataFrame, similarity: float) -> DataFrame:
    """(a, b): pairs of nodes that meet in a cell and reach the cosine, enough to connect every class of them."""
    rows = materialise(hashed(nodes, similarity), "cells")
    key = ["label", "dim", "cell"]
    shared = rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("home").alias("any")).where("n > 1 and any").select("cell")
    met = rows.join(shared, "cell").join(nodes.select("node", "label", F.length("v").alias("dim"), "v"), "node")

    def spanning(pdf: pd.DataFrame, size: np.ndarray) -> pd.DataFrame:
        out = []
        for same, own in by_dim(pdf, size):
            parent, node = np.arange(len(same)), same["node"].to_numpy(np.int64)
            for i, j in like(matrix(same["v"]), own, same["first"].to_numpy(), same["home"].to_numpy(bool), similarity):
                hook(parent, i, j)
            child = np.flatnonzero(parent != np.arange(len(same)))
            out.append(pd.DataFrame({"a": node[parent[child]], "b": node[child]}))
        return pd.concat(out, ignore_index=True)

    return compared(tiled(met, key), key, spanning, _PAIR)


def counted(members: DataFrame, similarity: float) -> DataFrame:
    """node, links: the weights of the other nodes of its class that reach the cosine.  members: root, node, n, v."""

    def weighed(pdf: pd.DataFrame, size: np.ndarray) -> pd.DataFrame:
        out = []
        for same, own in by_dim(pdf, size):
            n, total = same["n"].to_numpy(np.int64), np.zeros(len(same), np.int64)
            for i, j in like(matrix(same["v"]), own, same["first"].to_numpy(), np.ones(len(same), bool), similarity):
                np.add.at(total, i, n[j])
                np.add.at(total, j, n[i])
            out.append(pd.DataFrame({"node": same["node"].to_numpy(np.int64), "links": total}))
        return pd.concat(out, ignore_index=True)

    found = compared(tiled(members, ["root"]), ["root"], weighed, "node long, links long")
    return found.groupBy("node").agg(F.sum("links").alias("links"))


def near_duplicates(df: DataFrame, similarity: float = 0.98, id_column: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """id, n_links (other rows of the label whose cosine reaches `similarity`), component_id (the smallest id that links reach), kept."""
    every = materialise(prepared(df, id_column, vector, label), "vectors")
    nodes = every.where("h is not null").groupBy("h").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("v").alias("v"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    roots = components(materialise(links(nodes, similarity), "links"))
    members = materialise(roots.join(nodes, "node").select("root", "node", "n", "least", "v"), "members")
    lowest = members.groupBy("root", F.pmod(F.xxhash64("node"), F.lit(64)).alias("part")).agg(F.min("least").alias("low")).groupBy("root").agg(F.min("low").alias("low"))
    linked = members.select("node", "root").join(lowest, "root").join(counted(members.select("root", "node", "n", "v"), similarity), "node")
    result = nodes.select("h", "node", "n", "least").join(linked, "node", "left").select(
        "h", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("low")).alias("component_id")
    )
    own = every.select("id", "h")
    both = own.where("h is not null").join(materialise(result, "result"), "h").select("id", "n_links", "component_id")
    alone = own.where("h is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = both.unionByName(alone)
    return out.select(F.col("id").alias(id_column), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
