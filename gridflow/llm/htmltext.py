"""Main text of web pages by a maximum-scoring subsequence.

A page becomes a sequence of words and tags.  A word scores by the block it stands in, a tag costs; the main text is
the contiguous run with the largest sum, found in one pass (a running sum that starts anew when it falls below zero).
From that run come its blocks, without what is never article text wherever it stands: menus, page headers and footers,
sidebars, notices, adverts, forms, scripts, styles, hidden parts and reader comments.

Weights come from labelled pages: those that mark their article with an article or main element, over all pages.  A
block tag's words weigh the log odds of standing inside the marked article; a tag's cost falls with the log odds of
standing inside.  What is never article text is left out of the counts.  A name (of class, id or role) drops what it
holds only where the whole name says so; a name with other words beside such a one is in doubt, and its blocks weigh by the
log odds of those words to stand inside and by the mark: below zero they are left out, unless they are more words than
all that is not in doubt.  Where nothing is learned and nothing marked, they are words like others.  The mark is one more feature: the log odds of
marked and of unmarked words to stand in the run that the other weights find on the labelled pages.  On a page that
marks something a word adds its own; no word falls below the least weight, so the mark alone throws nothing away.  The
tables have one row for each known tag and word of a name, so they are bounded by the lists below.  Inline tags but links cost next to nothing.

Defined results: a null or empty page, or one without text, gives the empty text; unclosed and stray tags, a cut end
and a bare `<` are read as browsers read them; of equal runs the first and longest is taken; without labelled pages
the tables below start at the prior weights; repeated rows are read alike; an empty table gives none.  Only the html
column is read, and the columns named to be kept.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks

#: Elements that begin and end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main"
    " menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never article text.
NEVER = frozenset("head script style noscript template nav footer aside form button select textarea iframe object svg canvas video audio dialog menu fieldset search".split())
#: Elements whose content is read up to their end tag.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
MARKS = frozenset(("article", "main"))
INLINE = frozenset("a abbr b bdi bdo cite code data dfn em i kbd mark q s samp small span strong sub sup time u var font label ins del".split())
#: Words of names of what is not article text; a name with one of them is in doubt at least, if it begins or ends with it.
STRONG = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo banner cookie cookies consent gdpr popup modal nav navbar navigation menu breadcrumb breadcrumbs"
    " pagination pager sidebar sidebars footer masthead topbar toolbar comment comments respond disqus newsletter subscribe subscription signup login complementary contentinfo".split()
)
#: Words that say so only where the whole name consists of them, of those above and of plain words of layout.
WEAK = frozenset("side aside share sharing social related recommended search notice notices notification notifications alert alerts overlay widget widgets replies reply discussion skip hidden dialog promotion".split())
LAYOUT = frozenset(
    "site page top bottom left right bar box block panel list links link button buttons icon icons item items area section container wrapper inner outer post posts article articles stories content"
    " title text message messages region form field group row col column".split()
)
#: Words beside a strong one that take nothing back.
PLACES = frozenset(
    "body main header head wrap holder slot slots unit units zone rail spot placement label leaderboard skyscraper rectangle mpu inline middle center mid inside sticky fixed floating mobile desktop"
    " primary secondary global thread threads count author meta date reader readers user users pages".split()
)
#: Words that turn a name round: a page with or without a sidebar is not one.
TURNED = frozenset("no not non has with without is hide show".split())
HEADERS = frozenset(("header", "head"))
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: Prior weight of a word by its block and cost of a tag, and the bounds of learned ones.
WORD, TAG, MOST = 1.0, 0.5, 6.0
#: Weight of the mark for blocks in doubt; unmarked ones on a page with a mark take it from theirs.
MARK = 1.0
#: Least weight of a word and least cost of a tag.
LEAST_WORD, LEAST_TAG = 0.25, 0.01

KINDS = sorted(BLOCKS | VOID | INLINE | NEVER | {"other", "text"})


def unwanted_name(name: str, marked: bool) -> tuple[bool, list[str]]:
    """Whether one name of an element says that its content is not article text, and the words that put it in doubt if it does not."""
    words = [w for w in re.split(r"[\s_:-]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if w]
    if not words or not TURNED.isdisjoint(words):
        return False, []
    if not marked and words[-1] in HEADERS and set(words[:-1]) <= LAYOUT:
        return True, []
    plain = LAYOUT if STRONG.isdisjoint(words) else LAYOUT | PLACES
    said = [w for w in words if w not in plain and not re.fullmatch(r"\d+(x\d+)?", w)]
    if said and all(w in STRONG or w in WEAK for w in said):
        return True, []
    return False, [w for w in (words[0], words[-1]) if w in STRONG]


def unwanted(tag: str, attributes: str, marked: bool) -> tuple[bool, tuple[str, ...]]:
    """Whether an element's content is never article text, and the words of its names that put it in doubt if it is not."""
    if tag in NEVER or (tag == "header" and not marked):
        return True, ()
    if not attributes or not attributes.strip():
        return False, ()
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
        return True, ()
    if tag in ("html", "body", "article", "main") and not re.search(r"comment", found.get("class", "") + " " + found.get("id", ""), re.I):
        return False, ()
    said = [unwanted_name(x, marked) for k in ("class", "id", "role") for x in found.get(k, "").split()]
    if any(bad for bad, _ in said):
        return True, ()
    return False, tuple(sorted({w for _, doubts in said for w in doubts}))


class Open:
    """The elements under way: what a tag asks of them is answered without a walk over all."""

    #: An unclosed one of these does not hold the article; one of the others keeps it.
    LOOSE, TIGHT = frozenset(("nav", "header", "footer", "form", "head", "menu")), frozenset(("aside", "template", "noscript"))

    def __init__(self) -> None:
        self.stack: list[tuple[str, bool]] = []
        self.doubts: list[tuple[int, tuple[str, ...]]] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.never = self.marks = self.tight = 0
        self.loose: list[int] = []

    def push(self, tag: str, bad: bool, doubts: tuple[str, ...]) -> None:
        at = len(self.stack)
        self.stack.append((tag, bad))
        if doubts:
            self.doubts.append((at, tuple(sorted({*doubts, *self.doubtful()}))))
        self.places.setdefault(tag, []).append(at)
        if tag in BLOCKS:
            self.blocks.append(at)
        if bad and tag in self.LOOSE:
            self.loose.append(at)
        self.never += bad
        self.marks += tag in MARKS
        self.tight += tag in self.TIGHT

    def pop(self, to: int) -> None:
        while len(self.stack) > to:
            tag, bad = self.stack.pop()
            at = len(self.stack)
            self.places[tag].pop()
            if self.blocks and self.blocks[-1] == at:
                self.blocks.pop()
            if self.loose and self.loose[-1] == at:
                self.loose.pop()
            if self.doubts and self.doubts[-1][0] == at:
                self.doubts.pop()
            self.never -= bad
            self.marks -= tag in MARKS
            self.tight -= tag in self.TIGHT

    def doubtful(self) -> tuple[str, ...]:
        """The words of names around that put the content in doubt."""
        return self.doubts[-1][1] if self.doubts else ()

    def now(self) -> tuple[str, bool, bool, tuple[str, ...]]:
        return self.stack[self.blocks[-1]][0] if self.blocks else "other", self.never > 0, self.marks > 0, self.doubtful()

    def close(self, tag: str) -> None:
        """An inline element does not end beyond the block that holds its end tag."""
        k = self.places.get(tag)
        if k and (tag in BLOCKS or tag in NEVER or not self.blocks or self.blocks[-1] <= k[-1]):
            self.pop(k[-1])

    def before(self, tag: str) -> None:
        """What a block's start tag ends: a paragraph always, a list item or cell before the next one, and unclosed menus before the article."""
        if tag in BLOCKS and self.blocks:
            last = self.stack[self.blocks[-1]][0]
            if last == "p" or (last == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option")):
                self.pop(self.blocks[-1])
        if tag in MARKS and self.loose and not self.tight:
            self.pop(self.loose[0])


def read(page: str) -> list[tuple[str, str, bool, bool, tuple[str, ...], list[str]]]:
    """(text, block tag, never, marked, doubts, tags before it) for each block of text in page order; the tags after the last come with an empty text."""
    out: list[tuple[str, str, bool, bool, tuple[str, ...], list[str]]] = []
    open_ = Open()
    text: list[str] = []
    tags: list[str] = []
    state: tuple[str, bool, bool, tuple[str, ...]] = ("other", False, False, ())

    def flush() -> None:
        nonlocal tags
        words = " ".join(html.unescape("".join(text)).split())
        if words:
            out.append((words, *state, tags))
            tags = []
        text.clear()

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.match(page, at)
        at = m.end()
        name = m[2]
        if name is None:
            if m[0][:2] in ("<!", "<?"):
                continue
            inside = open_.now()
            if inside[1:] != state[1:] or not text:
                flush()
                state = inside
            text.append(m[0])
            continue
        tag = name.lower()
        block = tag in BLOCKS or tag in NEVER
        if block:
            flush()
        if m[1]:  # end tag
            tags.append("/" + tag)
            open_.close(tag)
            continue
        if tag == "br" or tag == "wbr":
            text.append(" " if tag == "br" else "")
            continue
        tags.append(tag)
        if block:
            open_.before(tag)
        if tag in VOID or m[3].endswith("/"):
            continue
        bad, doubts = unwanted(tag, m[3], open_.marks > 0)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*[^>]*(?:>|$)", re.I).search(page, at)
            at = close.end() if close else end
            continue
        open_.push(tag, bad, doubts)
    flush()
    out.append(("", *open_.now(), tags))
    return out


def blocks(page: str, weights: dict[str, float] | None = None) -> list[tuple[str, str, bool, bool, list[str]]]:
    """(text, block tag, never, marked, tags before it) for each block of text, with the names in doubt decided by the weights."""
    found, weights = read(page), weights or {}
    if not any(b[4] for b in found):
        return [(text, block, never, marked, tags) for text, block, never, marked, _, tags in found]
    open_ = [b for b in found if b[0] and not b[2]]
    has_mark = any(b[3] for b in open_)
    size = lambda rows: sum(b[0].count(" ") + 1 for b in rows)
    mainly = size(b for b in open_ if b[4]) > size(b for b in open_ if not b[4])
    out = []
    for text, block, never, marked, doubts, tags in found:
        mark = (MARK if marked else -MARK) if has_mark else 0.0
        bad = bool(doubts) and not mainly and mark + sum(weights.get(f"n:{w}", 0.0) for w in doubts) < 0
        out.append((text, block, never or bad, marked, tags))
    return out


def kind(tag: str) -> str:
    tag = tag.lstrip("/")
    return tag if tag in BLOCKS or tag in VOID or tag in INLINE or tag in NEVER else "other"


def fit(pages: DataFrame, column: str = "html") -> dict[str, float]:
    """Weights by `w:<block>`, `t:<tag>`, `n:<word of a name>` and `m:<marked>`, from every page that marks its article."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: Counter[tuple[str, bool]] = Counter()
        for pdf in batches:
            for page in pdf["page_"]:
                found = read(page)
                if not any(b[3] for b in found):
                    continue
                for text, block, never, inside, doubts, tags in found:
                    if never:  # never article text whatever the weights
                        continue
                    n = text.count(" ") + 1 if text else 0
                    sums[f"w:{kind(block)}", inside] += n
                    for w in doubts:
                        sums[f"n:{w}", inside] += n
                    for t in tags:
                        sums[f"t:{kind(t)}", inside] += 1
        yield pd.DataFrame([(k, int(i), n) for (k, i), n in sums.items()], columns=["feature", "inside", "n"])

    marked = pages.select(F.col(column).alias("page_")).where(F.lower("page_").rlike("<(article|main)[\\s>]"))
    rows = marked.mapInPandas(count, "feature string, inside int, n long").groupBy("feature", "inside").agg(F.sum("n").alias("n")).collect()  # a few rows for each known tag and word
    counts = {(r["feature"], r["inside"]): r["n"] for r in rows}
    weights = {}
    for f in {f for f, _ in counts}:
        odds = math.log(counts.get((f, 1), 0) + 1) - math.log(counts.get((f, 0), 0) + 1)
        weights[f] = max(-MOST, min(MOST, odds))

    def agree(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Words of marked pages by whether they are marked and stand in the run that the other weights find."""
        sums: Counter[tuple[int, int]] = Counter()
        for pdf in batches:
            for page in pdf["page_"]:
                found = blocks(page, weights)
                if any(b[3] for b in found):
                    run = set(region(found, weights)[0])
                    for i, (text, _, never, inside, _) in enumerate(found):
                        if text and not never:
                            sums[int(inside), int(i in run)] += text.count(" ") + 1
        yield pd.DataFrame([(i, k, n) for (i, k), n in sums.items()], columns=["inside", "run", "n"])

    rows = marked.mapInPandas(agree, "inside int, run int, n long").groupBy("inside", "run").agg(F.sum("n").alias("n")).collect()  # four at most
    if rows:
        seen = {(r["inside"], r["run"]): r["n"] for r in rows}
        for i in (0, 1):
            odds = math.log(seen.get((i, 1), 0) + 1) - math.log(seen.get((i, 0), 0) + 1)
            weights[f"m:{i}"] = max(-MOST, min(MOST, odds))
    return weights


def best_run(scores: np.ndarray) -> tuple[int, int]:
    """[a, b) of the contiguous run with the largest positive sum; (0, 0) if there is none."""
    total = low = top = 0.0
    start = a = b = 0
    for i, s in enumerate(scores):
        total += s
        if total - low > top + 1e-9:
            top, a, b = total - low, start, i + 1
        if total < low - 1e-9:
            low, start = total, i + 1
    return a, b


def region(found: list[tuple[str, str, bool, bool, list[str]]], weights: dict[str, float]) -> tuple[list[int], float]:
    """The blocks of text in the best run, without what is never article text, and the run's score."""
    has_mark = any(marked and not never and text for text, _, never, marked, _ in found)
    scores, which = [], []
    for i, (text, block, never, marked, tags) in enumerate(found):
        for t in tags:
            odds = weights.get(f"t:{kind(t)}", 0.0)
            scores.append(-LEAST_TAG if t.lstrip("/") in INLINE - {"a"} else -max(LEAST_TAG, TAG - odds / 2))
            which.append(-1)
        if not text:
            continue
        n = text.count(" ") + 1
        if never:
            own = 0.0  # left out of the text, so it neither draws the run in nor splits it
        else:
            own = max(LEAST_WORD, WORD + weights.get(f"w:{kind(block)}", 0.0) + (weights.get(f"m:{int(marked)}", 0.0) if has_mark else 0.0))
        scores.append(own * n)
        which.append(i)
    a, b = best_run(np.array(scores))
    return [i for i in which[a:b] if i >= 0 and not found[i][2]], float(sum(scores[a:b]))


def extract(page: str | None, weights: dict[str, float]) -> tuple[str, float]:
    """The main text and the score of its run."""
    if not page:
        return "", 0.0
    found = blocks(page, weights)
    kept, score = region(found, weights)
    return "\n".join(found[i][0] for i in kept), score


def main_text(pages: DataFrame, weights: dict[str, float], column: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns `keep`, text and n_chars of every page."""
    picked = pages.select(*keep, F.col(column).alias("page_"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1]) + ", text string, n_chars long, region_score double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in chunks(batches, 4_000_000, "page_"):
            rows = [extract(p, weights) for p in pdf["page_"]]
            yield pdf[list(keep)].assign(text=[t for t, _ in rows], n_chars=[len(t) for t, _ in rows], region_score=[s for _, s in rows])

    return picked.mapInPandas(run, schema)
