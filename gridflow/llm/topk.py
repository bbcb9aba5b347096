"""Exact top-k search by inner product, over vectors in descending order of length.

Components become integers floor(scale * x).  The Gram matrix of all vectors, summed in the tasks, gives a rotation
(its eigenvectors, i.e. the right singular vectors) that moves most of every product into the first coordinates.
Vectors are split by descending length into blocks; queries into blocks of their own.  The longest vectors are scored
first and give each query a k-th best score to beat.  A pair of blocks is then only made where the largest lengths
allow a score as high (Cauchy-Schwarz), and inside a pair the partial product over the first rotated coordinates plus
the product of the residual lengths bounds each score; what cannot reach the query's k-th best is dropped, and what
is left is scored exactly in integers.  Every bound is widened by more than the rounding error, so no score is lost.

A query meets the candidates block by block: the work is the stated query set against all rows, and each block pair
returns at most k rows a query.  A candidate block is sent to a task once, and the query blocks that need it stream past;
where there are many, they are split into shares with a copy of the block each, so that copies weigh no more than the
queries do and no task has them all.  Candidate blocks grow with the table up to a bound, so what is sent is the input
and the queries once for each bounded block whose length bound lets them in.

Defined results: a vector that is null, or holds a null or non-finite component, takes no part as query or candidate;
an empty vector scores 0 with any other; vectors of unequal dimensions are compared within their own dimension only;
ties go to the smaller id; rows with equal ids are different candidates unless they carry the query's own id; fewer
than k candidates give all; scores beyond the range of a long are held at its ends; empty tables give none.  Only the
id and vector columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, parts

#: Least vectors in a candidate block, and vectors in a query block.
BLOCK, QUERIES = 2048, 1024
#: Most bytes of a candidate block, and candidate blocks wanted for each shuffle partition.
BLOCK_BYTES, SPREAD = 16_000_000, 4
#: Numbers of all rotations together: the commonest dimensions are rotated, others take their coordinates as they are.
ROTATED = 4_000_000
#: Candidate blocks whose numbers and lengths (24 bytes each) are broadcast.
MOST_BROADCAST = 1_000_000
#: Candidates scored between two looks at the k-th best; rotated coordinates of the partial products.
STRIDE, LEAD = 256, 16
_BLOCK = "dim int, block long, ids binary, ints binary, top double"
_HIT = "query_id long, vec_id long, score long"


def integers(df: DataFrame, id_column: str, vector: str, scale: float, *more: str) -> DataFrame:
    """id, v (array<double> of whole numbers), dim, norm2 and `more` columns of the vectors that take part."""
    v = F.transform(F.col(vector), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
    fine = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    return (
        df.where(F.col(vector).isNotNull() & fine & F.col(id_column).isNotNull())
        .select(F.col(id_column).cast("long").alias("id"), v.alias("v"), *more)
        .withColumn("dim", F.size("v"))
        .withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    )


def rotations(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For the commonest dimensions, the eigenvectors of the Gram matrix, largest eigenvalue first; `ROTATED` numbers at most."""
    picked, room = [], ROTATED
    for r in vectors.where("dim > 0").groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(1000).collect():
        if r["dim"] ** 2 <= room:
            picked.append(r["dim"])
            room -= r["dim"] ** 2

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for dim, part in pdf.groupby("dim"):
                x = np.stack(part["v"].to_numpy()) if dim else np.zeros((len(part), 0))
                x = x / np.maximum(1, np.sqrt((x * x).sum(axis=1, keepdims=True)))
                sums[dim] = sums.get(dim, 0) + x.T @ x
        for dim, g in sums.items():
            yield pd.DataFrame({"dim": [dim] * dim, "row": range(dim), "g": list(g)})

    rows = vectors.where(F.col("dim").isin(picked)).select("dim", "v").mapInPandas(gram, "dim int, row int, g array<double>")
    summed = rows.select("dim", "row", F.posexplode("g").alias("col", "g")).groupBy("dim", "row", "col").agg(F.sum("g").alias("g"))
    found: dict[int, np.ndarray] = {}
    for dim, part in summed.toPandas().groupby("dim"):
        g = np.zeros((dim, dim))
        g[part["row"], part["col"]] = part["g"]
        found[int(dim)] = np.linalg.eigh((g + g.T) / 2)[1][:, ::-1]
    return found


def blocks(vectors: DataFrame, size: int) -> DataFrame:
    """Rows of up to `size` vectors of one dimension in descending order of length: ids, integers and the largest length."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            for _, part in pdf.groupby("dim", sort=False):
                if held and (held[0]["dim"].iloc[0] != part["dim"].iloc[0] or sum(map(len, held)) >= size):
                    yield block(pd.concat(held, ignore_index=True))
                    held = []
                for a in range(0, len(part), size):
                    if held and sum(map(len, held)) + len(part.iloc[a : a + size]) > size:
                        yield block(pd.concat(held, ignore_index=True))
                        held = []
                    held.append(part.iloc[a : a + size])
        if held:
            yield block(pd.concat(held, ignore_index=True))

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["v"].to_numpy()).astype("<f8") if pdf["dim"].iloc[0] else np.zeros((len(pdf), 0))
        if np.abs(x).max(initial=0) < 2**31:
            x = x.astype("<i4")
        return pd.DataFrame({
            "dim": [int(pdf["dim"].iloc[0])], "block": [0], "ids": [pdf["id"].to_numpy(dtype="<i8").tobytes()],
            "ints": [x.tobytes()], "top": [float(np.sqrt(pdf["norm2"].max()))],
        })

    ranged = vectors.repartitionByRange(F.col("dim"), F.desc("norm2"), F.col("id")).sortWithinPartitions("dim", F.desc("norm2"), "id")
    return ranged.mapInPandas(pack, _BLOCK).withColumn("block", F.monotonically_increasing_id())


def numbers(data: bytes, n: int, dim: int) -> np.ndarray:
    """A block's vectors as doubles; four or eight bytes a number."""
    return np.frombuffer(data, "<i4" if len(data) == 4 * n * dim else "<f8").reshape(n, dim).astype(np.float64)


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer products [q, x]; in doubles where they are exact there, else in whole numbers held at the ends of a long."""
    reach = max(1.0, np.abs(q).max(initial=0)) * max(1.0, np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if reach < 2**53:
        return (q @ x.T).astype(np.int64)
    whole = [[int(c) for c in row] for row in x]
    ends = (-(2**63), 2**63 - 1)
    return np.array([[max(ends[0], min(ends[1], sum(a * b for a, b in zip(map(int, row), y, strict=True)))) for y in whole] for row in q], np.int64)


class Candidates:
    """A block of vectors by descending length, rotated once for all queries."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, turn: np.ndarray | None) -> None:
        order = np.lexsort((ids, -(x * x).sum(axis=1)))
        self.ids, self.x, self.turn = ids[order], x[order], turn
        self.length = np.sqrt((self.x * self.x).sum(axis=1))
        self.lead, self.rest = self.split(self.x)

    def split(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first rotated coordinates, and the length of the rest."""
        turned = x if self.turn is None else x @ self.turn
        return turned[:, :LEAD].copy(), np.sqrt(np.maximum(0, (turned[:, LEAD:] ** 2).sum(axis=1)))


def scan(qid: np.ndarray, q: np.ndarray, bar: np.ndarray, held: Candidates, k: int) -> pd.DataFrame:
    """The k best of a block's vectors for each query; `bar`: a score that each query's k-th best is known to reach."""
    best_s = np.full((len(q), k), np.iinfo(np.int64).min)
    best_i = np.full((len(q), k), np.iinfo(np.int64).max)
    some = np.zeros((len(q), k), bool)
    x, xid, length = held.x, held.ids, held.length
    own = np.sqrt((q * q).sum(axis=1))
    lead_q, rest_q = held.split(q)
    bar = bar.astype(np.float64)
    for a in range(0, len(x), STRIDE):
        slack = 1 + 1e-9 * own * length[a]
        live = np.flatnonzero(own * length[a] + slack >= bar)  # the longest vector left bounds all the rest
        if not len(live):
            break
        at = slice(a, a + STRIDE)
        bound = lead_q[live] @ held.lead[at].T + np.outer(rest_q[live], held.rest[at]) + slack[live, None]
        open_ = bound >= bar[live, None]
        rows, cols = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
        if not len(rows):
            continue
        mine, ids = live[rows], xid[at][cols]
        score = exact(q[mine], x[at][cols])
        fits = open_[np.ix_(rows, cols)] & (qid[mine][:, None] != ids[None, :])
        s = np.concatenate([best_s[mine], score], axis=1)
        i = np.concatenate([best_i[mine], np.broadcast_to(ids, score.shape)], axis=1)
        f = np.concatenate([some[mine], fits], axis=1)
        # descending score, then id; those that do not fit come last
        top = np.lexsort((i, ~s, ~f), axis=1)[:, :k]
        best_s[mine], best_i[mine], some[mine] = (np.take_along_axis(v, top, axis=1) for v in (s, i, f))
        full = some[mine].all(axis=1)
        bar[mine[full]] = np.maximum(bar[mine[full]], best_s[mine[full], -1].astype(np.float64) * (1 - 1e-12) - 1)
    r, c = np.nonzero(some)
    return pd.DataFrame({"query_id": qid[r], "vec_id": best_i[r, c], "score": best_s[r, c]})


def top_k(df: DataFrame, queries: Column, k: int = 5, id_column: str = "vec_id", vector: str = "embedding", scale: float = 256) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best among all other rows of `df`."""
    spark = df.sparkSession
    picked = df.select(F.col(id_column).alias("id_"), F.col(vector).alias("v_"), queries.alias("q_"))
    every = materialise(integers(picked, "id_", "v_", scale, "q_"), "vectors")
    turns = rotations(every)
    n, widest = every.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(1))).first()
    size = max(BLOCK, min(n // (SPREAD * parts(spark)), BLOCK_BYTES // (4 * max(1, widest))))
    asked = materialise(blocks(every.where("q_"), QUERIES), "queries").withColumnsRenamed({"block": "qb", "ids": "qids", "ints": "qints", "top": "qtop"})
    held = materialise(blocks(every, size), "blocks")
    share = max(1, size // QUERIES)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, own = None, None
        for pdf in batches:
            for r in pdf.itertuples():
                ids = np.frombuffer(r.ids, "<i8")
                if r.query:
                    bar = np.frombuffer(r.bars, "<f8") if r.bars is not None else np.full(len(ids), -np.inf)
                    yield scan(ids, numbers(r.ints, len(ids), r.dim), bar, own, k)
                elif block != r.block:
                    block, own = r.block, Candidates(ids, numbers(r.ints, len(ids), r.dim), turns.get(r.dim))

    def paired(pairs: DataFrame, questions: DataFrame) -> DataFrame:
        """The query blocks of `questions` against the candidate blocks listed for them in `pairs` (qb, block)."""
        shares = pairs.groupBy("block").agg(F.ceil(F.count("*") / share).cast("int").alias("shares"))
        asking = pairs.join(shares, "block").withColumn("part", F.pmod(F.xxhash64("qb"), "shares").cast("int")).drop("shares")
        asking = asking.join(questions, "qb").select("block", "part", F.lit(True).alias("query"), "dim", F.col("qids").alias("ids"), F.col("qints").alias("ints"), "bars")
        copies = held.join(shares, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
        copies = copies.select("block", "part", F.lit(False).alias("query"), "dim", "ids", "ints", F.lit(None).cast("binary").alias("bars"))
        both = copies.unionByName(asking).repartition(parts(spark), "block", "part").sortWithinPartitions("block", "part", "query")
        return both.mapInPandas(compare, _HIT)

    # the first block of each dimension holds its longest vectors: it gives every query a score to beat
    longest = held.groupBy("dim").agg(F.max_by("block", F.struct("top", -F.col("block"))).alias("block"))
    first = materialise(paired(asked.join(longest, "dim").select("qb", "block"), asked.withColumn("bars", F.lit(None).cast("binary"))), "first")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = first.withColumn("r", F.row_number().over(place)).where(F.col("r") == k).select("query_id", F.col("score").alias("bar"))
    members = asked.select("qb", "qids", "dim")

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                ids = np.frombuffer(r.qids, "<i8")
                yield pd.DataFrame({"qb": r.qb, "at": np.arange(len(ids)), "query_id": ids})

    seats = members.mapInPandas(listed, "qb long, at int, query_id long").join(kth, "query_id", "left")
    ranked = seats.groupBy("qb").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce(F.col("bar").cast("double"), F.lit(float("-inf"))).alias("bar")))).alias("s"))

    def joined(pdf: pd.Series) -> pd.Series:
        return pdf.map(lambda s: np.array([x["bar"] for x in s], "<f8").tobytes())

    bars = ranked.select("qb", F.pandas_udf(joined, "binary")("s").alias("bars"), F.array_min(F.transform("s", lambda x: x["bar"])).alias("low"))
    ready = materialise(asked.join(bars, "qb"), "ready")
    # (query block, candidate block) numbers whose largest lengths allow a score to be beaten; only numbers meet here
    others = held.join(longest.select("dim", F.col("block").alias("done")), "dim").where("block <> done").select("dim", "block", "top")
    if held.count() <= MOST_BROADCAST:
        others = F.broadcast(others)
    pairs = ready.select("qb", "dim", "qtop", "low").join(others, "dim").where("low = double('-Infinity') or qtop * top * (1 + 1e-9) + 1 >= low").select("qb", "block")
    rest = paired(materialise(pairs, "pairs"), ready)
    both = first.unionByName(rest).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return both.select("query_id", "rank", "vec_id", "score")
