"""Runs of repeated words, by a dictionary of basic factors.

Level k names every stretch of 2**k words, equal stretches alike: level 0 names words, and a name of level k + 1 is a pair
of names of level k.  A place whose name occurs once in its text is dropped, as no longer stretch there occurs twice.  At
each level the next occurrence of a place's name is its successor; where it is at most twice the stretch away, places that
follow each other with one and the same step are an arithmetic progression, and the step is a proposed period.

A progression whose step q is no longer than its factor (L words) is the whole run: within a run of smallest period q two
equal factors of q words or more are whole periods apart, so each place's successor is q away, and the progression from a
to b breaks off exactly where the repetition does.  It is extended by its factor and its step, to (b - a) + L + q words
from a, and cannot be longer either way.  A longer step is proposed again at the next level, by a factor that reaches it.
A run of at least three periods is found at the level whose factor is its period, rounded up to a power of two, and may
be found again above it: the findings are made distinct.

Each text is read whole, in pieces, and held as numbers of its distinct words; texts of a batch are named together, as
words of different texts have different numbers.  Two levels are held at once.

Defined results: a null text and one without words have no runs and an empty collapsed text; rows are judged one by one,
so repeated and null ids go each for itself; an empty table gives none; only the id and text columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_chunks

#: Least periods and words of a run.
TIMES, LEAST = 4, 6
#: Bytes of texts that are named together; bytes of a text that are split at once, and words that are joined at once.
BATCH, PIECE, JOINED = 2_000_000, 1 << 20, 1 << 16
SPACE = re.compile(rb"[ \t-\r]")
#: Which words stand in a text instead of its own: from its id and number of words to places, or None for the text as it is.
Reword = Callable[[int | None, int], np.ndarray | None]


def pieces(data: bytes, size: int = PIECE) -> Iterator[bytes]:
    """A text in pieces that end between words."""
    at = 0
    while at < len(data):
        cut = SPACE.search(data, at + size)
        end = cut.start() if cut else len(data)
        yield data[at:end]
        at = end


def numbered(data: bytes | None) -> tuple[list[bytes], np.ndarray]:
    """The distinct words of a text in order of appearance, and the text as numbers of them."""
    seen: dict[bytes, int] = {}
    parts = [np.array([seen.setdefault(w, len(seen)) for w in p.split()], np.int32) for p in pieces(data or b"")]
    return list(seen), np.concatenate(parts) if parts else np.zeros(0, np.int32)


def runs(ids: np.ndarray, ends: np.ndarray, times: int = TIMES, least: int = LEAST) -> np.ndarray:
    """start, length, period of each run in a chain of texts, by start and period.

    ids: numbers of words, different in different texts; ends: where each text ends in the chain.
    """
    n = len(ids)
    sizes = np.diff(ends, prepend=0)
    end = np.repeat(ends, sizes)
    longest = int(sizes.max(initial=0))
    found = [np.zeros((0, 3), np.int64)]
    name, pos = ids.astype(np.int64), np.arange(n)
    often = np.bincount(name)[name] > 1 if n else np.zeros(0, bool)
    name, pos = name[often], pos[often]
    size = 1
    while len(pos) and (size == 1 or (size // 2 + 1) * times <= longest):
        order = np.argsort(name, kind="stable")
        gap = np.diff(pos[order])
        gap[(np.diff(name[order]) != 0) | (gap > 2 * size)] = 0
        step = np.zeros(len(pos), np.int64)
        step[order[:-1]] = gap
        first = np.flatnonzero((np.diff(step, prepend=-1) != 0) | (np.diff(pos, prepend=-2) != 1))
        last = np.append(first[1:], len(pos)) - 1
        q = step[first]
        length = pos[last] - pos[first] + size + q
        whole = (q > 0) & (q <= size) & (length >= np.maximum(least, times * q))
        found.append(np.stack([pos[first], length, q], axis=1)[whole])
        # the next level: pairs of names, of which those that occur once are dropped
        at = np.full(n, -1)
        at[pos] = np.arange(len(pos))
        fits = np.flatnonzero(pos + 2 * size <= end[pos])
        second = at[pos[fits] + size]
        fits, second = fits[second >= 0], second[second >= 0]
        pair = name[fits] * (int(name.max()) + 1) + name[second]
        _, name, count = np.unique(pair, return_inverse=True, return_counts=True)
        often = count[name] > 1
        name, pos = (np.cumsum(count > 1) - 1)[name[often]], pos[fits[often]]
        size *= 2
    every = np.unique(np.concatenate(found), axis=0)
    return every[np.lexsort((every[:, 2], every[:, 0]))]


def repeated(found: np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie in a run after its first period."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, found[:, 0] + found[:, 2], 1)
    np.add.at(delta, found[:, 0] + found[:, 1], -1)
    return np.cumsum(delta[:n]) > 0


def joined(words: list[bytes], ids: np.ndarray) -> bytes:
    """Words by number, with a space between any two."""
    return b" ".join(b" ".join([words[i] for i in ids[a : a + JOINED].tolist()]) for a in range(0, len(ids), JOINED))


def collapse(df: DataFrame, id_column: str = "doc_id", text: str = "text", times: int = TIMES, least: int = LEAST, reword: Reword | None = None) -> DataFrame:
    """id, n_words, runs (array of start, length, period by start and period), collapsed: the text without what repeats in runs.

    A run is a stretch of words of smallest period q, of at least `times` periods and `least` words, that no neighbouring
    word extends; what it holds after its first q words is left out of `collapsed`, where words are joined by one space.
    `times` is 3 at least.
    """
    if times < 3:
        raise ValueError("a run has three periods at least")
    item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_chunks(batches, BATCH, "text"):
            texts, held, base = [], [], 0
            for doc_id, data in zip(batch.column("id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                words, ids = numbered(data)
                if reword is not None and (places := reword(doc_id, len(ids))) is not None:
                    ids = ids[places]
                texts.append((words, ids))
                held.append(ids.astype(np.int64) + base)
                base += len(words)
            ends = np.cumsum([len(ids) for _, ids in texts])
            found = runs(np.concatenate(held), ends, times, least)
            cuts = np.searchsorted(found[:, 0], np.append(0, ends))
            own = [found[a:b] - [s, 0, 0] for a, b, s in zip(cuts[:-1], cuts[1:], np.append(0, ends[:-1]), strict=True)]
            kept = [joined(words, ids[~repeated(r, len(ids))] if len(r) else ids) for (words, ids), r in zip(texts, own, strict=True)]
            flat = np.concatenate(own)
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), pa.array([len(ids) for _, ids in texts], pa.int64()),
                pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, i], pa.int64()) for i in range(3)], fields=list(item))),
                pa.array(kept, pa.binary()).cast(pa.string()),
            ], ["id", "n_words", "runs", "collapsed"])

    picked = df.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text"))
    out = picked.mapInArrow(run, "id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return out.withColumnRenamed("id", id_column)
