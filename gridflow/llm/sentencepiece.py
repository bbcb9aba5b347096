"""SentencePiece encoding and decoding by a batched Viterbi search.

The pieces and scores come from a public .model file.  A text gets a leading space (if the model asks for it), spaces
become the mark U+2581, and it falls into words before each run of marks, which no piece crosses.  The distinct words
of a chunk are encoded once: words of equal length form a matrix (beyond 16 characters those of a class of lengths, filled
up with a character that no piece has); a rolling polynomial hash gives every substring of every word at once; the hashes
probe the sorted keys of the pieces, behind a table of bits that turns most of them away, and what they find is compared
with the piece; then one position after the other, for all words together, a vectorised maximum over piece lengths gives
the best score and stores the backpointer.  A word of more than `LONG` characters goes through the same probes and maxima
alone, in segments that carry the last scores on.  A character that no piece covers takes the unknown penalty and, where the model has byte pieces, becomes its UTF-8 bytes; neighbouring
unknowns stay separate then, as in the library.

Scores: the public file holds a merge-ordered vocabulary whose scores are ranks, not log probabilities.  `zipf` reads
rank r as log(1 / (r + 1)), a unigram model over the same pieces and ids; `as_is` takes the file's scores.  Ids are
those of the best segmentation under these scores; the merge order itself is not replayed (see the README).

Defined results: a null or empty text has no ids and decodes to the empty text; decoding gives back every text exactly,
but for U+2581 itself, which decodes to a space, as in the library; a word may be as long as its text; ties go to
the longer last piece, as in the library; repeated rows are encoded alike; an empty table gives none; only doc_id and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks

MARK = "▁"
WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Multiplier of the rolling hash, modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Substrings of a batch of words (words x positions x piece lengths), which bounds its memory.
ENTRIES = 4_000_000
#: Lengths of the classes of longer words, the longest word that is encoded with others, and the characters of a segment.
CLASSES = np.array([*range(1, 17), 20, 24, 30, 38, 48, 60, 76, 96, 120, 150, 190, 240, 300])
LONG, SEGMENT = 300, 65_536
#: Fills words up to their class: no character.
FILL = 0x110000
#: Bits of the table before the sorted keys; bytes of remembered words.
TABLE_BITS, REMEMBERED = 21, 40_000_000
UNKNOWN_PENALTY = 10.0
ENCODED = "doc_id long, ids array<int>, n_tokens long, decoded string"


class Pieces:
    """The vocabulary of a .model file: normal pieces by hash, byte pieces, unknown id."""

    def __init__(self, path: str, scores: str = "zipf") -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        kinds = pb.ModelProto.SentencePiece
        self.prefix = proto.normalizer_spec.add_dummy_prefix
        self.pieces = [p.piece for p in proto.pieces]
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == kinds.UNKNOWN)
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        self.of_byte = {i: b for b, i in self.byte.items()}
        self.control = {i for i, p in enumerate(proto.pieces) if p.type == kinds.CONTROL}
        ids = [i for i, p in enumerate(proto.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED) and p.piece]
        own = np.array([proto.pieces[i].score for i in ids], np.float64)
        if scores == "zipf":
            order = np.argsort(-own, kind="stable")
            rank = np.empty(len(own))
            rank[order] = np.arange(len(own))
            own = -np.log(rank + 1)
        self.whole = not any(re.search(f"[^{MARK}]{MARK}", self.pieces[i]) for i in ids)
        text = [np.array(list(map(ord, self.pieces[i])), np.uint64) for i in ids]
        self.longest = max(map(len, text))
        keys = np.array([key(t[None])[0] for t in text], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids, self.scores = keys[order], np.array(ids, np.int32)[order], own[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a hash; choose another base")
        self.lengths = np.array(list(map(len, text)), np.int32)[order]
        self.points = np.full((len(order), self.longest), FILL, np.uint32)
        for i, k in enumerate(order):
            self.points[i, : len(text[k])] = text[k]
        self.maybe = np.zeros(1 << TABLE_BITS, bool)
        self.maybe[self.slot(self.keys)] = True
        self.least = float(own.min()) - UNKNOWN_PENALTY
        self.fresh: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.room = REMEMBERED

    def slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes * BASE) >> np.uint64(64 - TABLE_BITS)

    def split(self, text: str) -> list[str]:
        if not text:
            return []
        marked = (MARK if self.prefix else "") + text.replace(" ", MARK)
        return WORD.findall(marked) if self.whole else [marked]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids (little-endian 32-bit) of distinct words.  Those of the words met last are remembered, in two generations of bounded size."""
        found = [self.fresh.get(w) or self.old.get(w) for w in words]
        lost = [i for i, x in enumerate(found) if x is None]
        size = np.fromiter((len(words[i]) for i in lost), np.int64, len(lost))
        group = np.searchsorted(CLASSES, size)
        order = np.argsort(group, kind="stable")
        for a, b in pairwise([*np.flatnonzero(np.diff(group[order], prepend=-1)), len(order)]):
            if size[order[a]] > LONG:
                for k in order[a:b]:
                    found[lost[k]] = self.long_word(words[lost[k]])
                continue
            n = int(CLASSES[group[order[a]]])
            step = max(1, ENTRIES // (n * min(n, self.longest)))
            for c in range(a, b, step):
                own = order[c : min(b, c + step)]
                filled = "".join(words[lost[k]].ljust(n, "\0") for k in own)
                grid = np.frombuffer(filled.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(own), n).copy()
                grid[np.arange(n) >= size[own][:, None]] = FILL
                for k, x in zip(own, self.viterbi(grid, size[own]), strict=True):
                    found[lost[k]] = x
        for w, x in zip(words, found, strict=True):
            if w not in self.fresh and len(w) <= LONG:
                self.fresh[w] = x
                self.room -= 160 + len(w) + len(x)
                if self.room < 0:
                    self.fresh, self.old, self.room = {}, self.fresh, REMEMBERED
        return found

    def hits(self, h: np.ndarray, points: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the flat hashes h of substrings of d + 1 characters that are pieces, and which; points[k]: their k-th characters."""
        at = np.flatnonzero(self.maybe[self.slot(h)])
        own = h[at]
        piece = np.searchsorted(self.keys, own)
        piece[piece == len(self.keys)] = 0
        same = (self.keys[piece] == own) & (self.lengths[piece] == d + 1)
        at, piece = at[same], piece[same]
        true = np.ones(len(at), bool)
        for k in range(d + 1):
            true &= points[k][at] == self.points[piece, k]
        return (at, piece) if true.all() else (at[true], piece[true])

    def viterbi(self, grid: np.ndarray, size: np.ndarray) -> list[bytes]:
        """The best ids of words given as code points [words, length], each by its own size."""
        words, n = grid.shape
        top = min(self.longest, n)
        points = np.ascontiguousarray(grid.T)
        wide = points.astype(np.uint64) + np.uint64(1)
        h = np.zeros((n, words), np.uint64)  # hash of the substring of d + 1 characters that begins at each place
        found = []
        for d in range(top):
            h = h[: n - d] * BASE + wide[d:]
            at, piece = self.hits(h.reshape(-1), [points[k:].reshape(-1) for k in range(d + 1)], d)
            cuts = np.searchsorted(at, np.arange(n - d + 1) * words)
            found.append((at, piece, cuts))
        best = np.zeros((n + 1, words))  # of the first e characters
        back, pick = np.zeros((n + 1, words), np.int16), np.full((n + 1, words), -1, np.int32)
        for e in range(1, n + 1):
            best[e] = best[e - 1] + self.least  # an unknown character, where it has no piece of its own
            at, piece, cuts = found[0]
            best[e, at[cuts[e - 1] : cuts[e]] - (e - 1) * words] = -np.inf
            for d in range(min(top, e)):  # the longest last, which takes ties
                at, piece, cuts = found[d]
                a, b = cuts[e - 1 - d], cuts[e - d]
                if a == b:
                    continue
                row, own = at[a:b] - (e - 1 - d) * words, piece[a:b]
                total = best[e - 1 - d, row] + self.scores[own]
                better = total >= best[e, row]
                row = row[better]
                best[e, row], back[e, row], pick[e, row] = total[better], d, own[better]
        # walk back, all words together
        taken = np.full((words, n), -2, np.int32)
        r, end = np.arange(words), size.copy()
        while len(r := r[end[r] > 0]):
            e = end[r]
            taken[r, e - 1] = pick[e, r]
            end[r] = e - 1 - back[e, r]
        keep = taken != -2
        flat = np.where(taken[keep] < 0, -1, self.ids[taken[keep]]).astype("<i4").tobytes()
        ends = 4 * np.cumsum(keep.sum(axis=1))
        out = [flat[a:b] for a, b in pairwise([0, *ends.tolist()])]
        for i in np.flatnonzero((taken == -1).any(axis=1)):
            out[i] = self.spelled(grid[i], np.flatnonzero(taken[i] != -2), taken[i][taken[i] != -2])
        return out

    def long_word(self, word: str) -> bytes:
        """The same for one long word, in segments; the scores of the last places go on from one to the next."""
        points = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)
        n, top = len(points), self.longest
        back, pick = np.zeros(n + 1, np.int16), np.full(n + 1, -1, np.int32)
        last = [0.0]  # best scores of the places up to where the segment begins
        for a in range(0, n, SEGMENT):
            b, low = min(n, a + SEGMENT), max(0, a + 1 - top)
            own = points[low:b]
            wide = own.astype(np.uint64) + np.uint64(1)
            h = np.zeros(len(own), np.uint64)
            ends, sizes, pieces = [], [], []
            for d in range(min(top, len(own))):
                h = h[: len(own) - d] * BASE + wide[d:]
                at, piece = self.hits(h, [own[k:] for k in range(d + 1)], d)
                inside = at + low + d + 1 > a
                ends.append(at[inside] + low + d + 1)
                pieces.append(piece[inside])
                sizes.append(np.full(int(inside.sum()), d, np.int64))
            end, size, piece = map(np.concatenate, (ends, sizes, pieces))
            order = np.lexsort((size, end))
            cuts = np.searchsorted(end[order], np.arange(a + 1, b + 2)).tolist()
            size, piece = size[order].tolist(), piece[order]
            score, piece = self.scores[piece].tolist(), piece.tolist()
            first = a + 1 - len(last)  # the place of last[0]
            for e in range(a + 1, b + 1):
                x, y = cuts[e - a - 1], cuts[e - a]
                lone = x == y or size[x] > 0
                most, which = (last[-1] + self.least, -1) if lone else (-np.inf, -1)
                for i in range(x, y):
                    total = last[e - 1 - size[i] - first] + score[i]
                    if total >= most:
                        most, which = total, i
                if which >= 0:
                    back[e], pick[e] = size[which], piece[which]
                last.append(most)
            last = last[-top:]
        places = []
        e = n
        while e > 0:
            places.append(e - 1)
            e -= 1 + int(back[e])
        places = np.array(places[::-1], np.int64)
        taken = pick[places + 1]
        if (taken == -1).any():
            return self.spelled(points, places, taken)
        return self.ids[taken].astype("<i4").tobytes()

    def spelled(self, points: np.ndarray, places: np.ndarray, taken: np.ndarray) -> bytes:
        """Ids of one word with its unknown characters as bytes, or as unknown where the model has no byte pieces; places: of the pieces' last characters."""
        out: list[int] = []
        for e, piece in zip(places.tolist(), taken.tolist(), strict=True):
            if piece != -1:
                out.append(int(self.ids[piece]))
            elif len(self.byte) == 256:
                out += [self.byte[b] for b in chr(points[e]).encode("utf-8", "surrogatepass")]
            else:
                out.append(self.unknown)
        return np.array(out, "<i4").tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes are joined before they are read as UTF-8."""
        if not len(ids):
            return ""
        if not hasattr(self, "raw"):
            self.raw = [
                b"" if i in self.control else bytes([self.of_byte[i]]) if i in self.of_byte else b" \xe2\x81\x87 " if i == self.unknown else p.replace(MARK, " ").encode("utf-8", "surrogatepass")
                for i, p in enumerate(self.pieces)
            ]
        text = b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass" if len(self.byte) == 256 else "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def key(points: np.ndarray) -> np.ndarray:
    """Hash of each row of code points."""
    h = np.zeros(len(points), np.uint64)
    for c in range(points.shape[1]):
        h = h * BASE + (points[:, c] + np.uint64(1))
    return h


@lru_cache(maxsize=4)
def pieces_of(path: str, scores: str) -> Pieces:
    return Pieces(path, scores)


def encode_decode(docs: DataFrame, path: str, scores: str = "zipf") -> DataFrame:
    """doc_id, ids, n_tokens and the text decoded from the ids, of every whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = pieces_of(path, scores)
        for pdf in chunks(batches, 2_000_000):
            split = [own.split(t or "") for t in pdf["text"]]
            per = np.fromiter(map(len, split), np.int64, len(split))
            code, distinct = pd.factorize(np.array([w for s in split for w in s], dtype=object))
            ids = own.encode_words(list(distinct))
            size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            flat = np.frombuffer(b"".join(ids), "<i4")
            first, n = np.cumsum(size) - size, size[code]
            ends = np.concatenate([[0], np.cumsum(n)])
            every = flat[np.repeat(first[code] - ends[:-1], n) + np.arange(ends[-1])]
            each = np.split(every, ends[np.cumsum(per)][:-1])
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"].astype("Int64"), "ids": each, "n_tokens": np.fromiter(map(len, each), np.int64, len(each)),
                "decoded": [own.decode(x) for x in each],
            })

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, ENCODED)
