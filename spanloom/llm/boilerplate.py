"""Problem 1: page furniture apart from the article, by minimum-cut labelling of lines.

Each non-blank line is a node. A fitted line classifier gives the log odds of furniture, which become the capacity to the
source (furniture) or the sink (article); lines are joined by smoothness edges by how near they stand in the flattened
page: next to each other, across blank lines, or two apart. The minimum cut, found by max-flow, is the labelling.

No word list is kept. What the classifier knows it learns from the collection:

1. All lines of all pages are counted: the pages, the different pages (by a minimum over hashed substrings, so that copies of one
   article count once) and the sites that carry a line, within its site and over all sites. Digits don't count.
2. On a sample of at most ``SAMPLE_PAGES`` pages (by hash of the id, with their counts) repeated lines that are no prose are
   the first examples of furniture; unique prose, list items and lone lines between two paragraphs are those of the article.
3. A logistic regression over counts, shape, place, words and their places is fitted, the edges are taken from how often
   neighbours agree, the sample is labelled by the cut, and both are fitted again on these labels, so that lines
   which only stand among furniture (teasers, trails) become examples too.
4. All pages are labelled with the fitted weights. Counts cover all pages; only the fit is bounded.

Cases: null, empty and blank texts have no rows; repeated records give their lines once and count as one page; lines are
numbered by ``\\n`` from 0, blank ones counted; a null site is a site of its own; a collection without repeated lines has
no examples of furniture, so everything is article.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, text_batches
from .hashing import Rolling, code_points

#: The classifier is fitted on at most so many pages, whatever the size of the collection.
SAMPLE_PAGES = 2_000
#: Substrings of so many code points stand for a page when different pages are counted.
PAGE_GRAM = 24
#: (site, line) pairs on at least this share of all lines are hot; there are at most so many of them as the inverse says.
HOT_SHARE = 1 / 20_000
BUCKETS = 1 << 15

SPACELESS = re.compile(r"[฀-๿぀-ヿ㐀-鿿]")
TOKEN = re.compile(r"[^\W\d_]+|\d+")
DIGITS = re.compile(r"\d+")
DIGIT = re.compile(r"\d")
CAPITAL = re.compile(r"(?<!\w)[A-ZÀ-ÞА-Я]")
CODED = re.compile(r"\d\w*")
MIXED = re.compile(r"\d[a-z]+\d|[a-z]\d+[a-z]")
STOPS = frozenset(".!?…。！？।؟")
CLOSERS = "\"'”’»“」』)）]"
PARTING = ("  ", " | ", " > ", " / ", " · ", " › ", " → ", "\t")
LIST_MARK = re.compile(r"(?:[-•–*]|\d{1,3}[.)])\s+")
#: What parts the entries of a menu or trail; wide blanks after a sentence do not.
SEPARATOR = re.compile(r"\s+[|/>·›→]\s+|(?<![.!?…。！？।؟”\"“»’'])\s{2,}")
INNER_MARK = re.compile(r"[.!?]\s+[^\W\d_]|[。！？।؟,，、;]")


# --- features of lines ---------------------------------------------------------------------------------------------


def line_key(stripped: str) -> int:
    """Hash of a line without its list mark, case and digits."""
    low = stripped.lower()
    m = LIST_MARK.match(low)
    if m:
        low = low[m.end() :]
    return xxhash.xxh3_64_intdigest(CODED.sub("0", low).encode("utf-8", "surrogatepass")) - (1 << 63)


#: The first buckets are kept for shapes, places and counts.
SHAPES = 160


def _bucket(w: str) -> int:
    return SHAPES + xxhash.xxh32_intdigest(w.encode("utf-8", "surrogatepass")) % (BUCKETS - SHAPES)


def _words(s: str) -> list[str]:
    """Word features of a line: its words, pairs of letters where words are not parted, and what stands first and last."""
    low = CODED.sub("0", s.lower())
    words = low.split()
    if not words:
        return [" "]
    out = words
    if not low.isascii() and SPACELESS.search(low):
        out = [w[i : i + 2] for w in words for i in range(len(w) - 1 or 1)]
    return out + ["^" + words[0], "^" + " ".join(words[:2]), words[-1] + "$"]


def _step(n: int, last: int) -> int:
    """0, 1, 2, 3 for 0, 1, 2-3, 4-7 and so on, up to ``last``."""
    return min(n.bit_length(), last)


def ends_sentence(s: str) -> bool:
    """Whether a stripped line ends with a sentence mark and perhaps what closes a quotation or parenthesis."""
    return s[-1] in STOPS or s[-1] in CLOSERS and s.rstrip(CLOSERS)[-1:] in STOPS


def parts_of(s: str) -> list[str]:
    """The entries of a menu or trail; a line without wide blanks or separators is one."""
    for mark in PARTING:
        if mark in s:
            return SEPARATOR.split(s)
    return [s]


def is_prose(s: str) -> bool:
    """Whether a line looks like sentences: long enough, with their marks, or in a script that has none."""
    if len(s) < 30:
        return False
    if not s.isascii() and SPACELESS.search(s):
        return len(parts_of(s)) < 2
    return len(s) >= 60 and (ends_sentence(s) or INNER_MARK.search(s) is not None) and len(parts_of(s)) < 3


def leads(numbers: list[int], prose: list[bool]) -> list[bool]:
    """Whether a line that is no prose stands right above prose, as headings do."""
    return [not a and b and j == i + 1 for a, b, i, j in zip(prose, prose[1:], numbers, numbers[1:])] + [False] * bool(numbers)


def page_lines(text: str) -> tuple[list[int], list[str], list[str], list[bool]]:
    """(numbers, lines, stripped lines, prose or not) of the non-blank lines of a page."""
    lines = text.split("\n")
    stripped = [x.strip() for x in lines]
    numbers = [i for i, s in enumerate(stripped) if s]
    stripped = [s for s in stripped if s]
    return numbers, lines, stripped, [is_prose(s) for s in stripped]


def page_shapes(numbers: list[int], lines: list[str], stripped: list[str], prose: list[bool]) -> list[list[int]]:
    """Features of shape and place of the non-blank lines of a page; what their neighbours are is left to the edges."""
    parted = [(s,) if p else parts_of(s) for s, p in zip(stripped, prose)]
    trails = {p[-1] for p in parted if len(p) > 2}
    whole = set(stripped) if trails else ()
    n = len(numbers)
    first = next((k for k, x in enumerate(prose) if x), n)
    last = next((k for k in range(n - 1, -1, -1) if prose[k]), -1)
    shapes = []
    for k, s in enumerate(stripped):
        size = len(s)
        own_prose = prose[k]
        end = 0 if ends_sentence(s) else 1 if s[-1] in ":：,،、;" else 2
        where = 0 if last < 0 else 1 if k < first else 3 if k > last else 2
        ids = [
            _step(size, 12),  # 0-12
            13 + end * 3 + (2 if size >= 60 else 1 if size >= 25 else 0),  # 13-21
            41 + where * 3 + (0 if end == 0 else 1 if size >= 25 else 2),  # 41-52
            76 + (k if k < 3 else 3),  # 76-79
            80 + (n - 1 - k if n - 1 - k < 3 else 3),  # 80-83
        ]
        if own_prose:
            ids += (22, 117)
        else:
            parts = parted[k]
            ids.append(22 + min(len(parts), 5))  # 22-27
            if len(parts) > 1:
                ids.append(28 + _step(size // len(parts), 7))  # 28-35
                if len(parts) > 2 and parts[-1] in whole:
                    ids.append(36)
            if s in trails and len(parts) < 3:
                ids.append(37)
            digits = len(DIGIT.findall(s))
            ids.append(68 + (0 if not digits else 1 if digits * 4 < size else 2))  # 68-70
            if digits and MIXED.search(s):
                ids.append(67)
            capitals = len(CAPITAL.findall(s))
            ids.append(72 + (0 if not capitals else 3 if capitals > s.count(" ") else 1 if capitals == 1 else 2))  # 72-75
            m = LIST_MARK.match(s)
            if m:
                ids.append(39 if m[0][0].isdigit() else 38)
            if "©" in s:
                ids.append(66)
            if INNER_MARK.search(s):
                ids.append(71)
        if lines[numbers[k]][0] != s[0]:
            ids.append(40)
        shapes.append(ids)
    return shapes


def count_ids(count: tuple[int, int, int, int, int] | None) -> list[int]:
    """Features of how often a line stands elsewhere: (different pages of the site, of all sites, pages, sites, right above prose)."""
    here, everywhere, pages, sites, leading = count or (1, 1, 1, 1, 0)
    ids = [84 + _step(everywhere, 9), 94 + _step(here, 7), 102 + _step(sites, 5)]  # 84-93, 94-101, 102-107
    ids.append(108 + (0 if everywhere * 4 < pages else 1 if everywhere * 2 < pages else 2))  # 108-110
    ids.append(111 + (5 if everywhere < 4 else 4 * leading // pages))  # 111-116
    return ids


# --- minimum cut ---------------------------------------------------------------------------------------------------


def _flow_labels(caps: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Labels of one undecided part by augmenting paths; True is the source side (furniture)."""
    n = len(caps)
    adj: list[dict[int, float]] = [{} for _ in range(n)]
    for (a, b), w in edges.items():
        adj[a][b] = adj[a].get(b, 0.0) + w
        adj[b][a] = adj[b].get(a, 0.0) + w
    room = caps[:]  # >0: left from the source, <0: left to the sink
    while True:
        # breadth-first from all nodes with source capacity to a node with sink capacity
        before = {i: -1 for i in range(n) if room[i] > 1e-12}
        queue, end = deque(before), -1
        while queue and end < 0:
            a = queue.popleft()
            for b, w in adj[a].items():
                if w > 1e-12 and b not in before:
                    before[b] = a
                    if room[b] < -1e-12:
                        end = b
                        break
                    queue.append(b)
        if end < 0:
            return [i in before for i in range(n)]
        path, a = [end], end
        while before[a] >= 0:
            a = before[a]
            path.append(a)
        amount = min(room[path[-1]], -room[end], *(adj[path[k + 1]][path[k]] for k in range(len(path) - 1)))
        room[path[-1]] -= amount
        room[end] += amount
        for k in range(len(path) - 1):
            adj[path[k + 1]][path[k]] -= amount
            adj[path[k]][path[k + 1]] = adj[path[k]].get(path[k + 1], 0.0) + amount


#: An undecided part of more lines than this is solved by the equivalent minimum over its chain, in linear time.
LONG_PART = 300


def _chain_labels(caps: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """The same minimum cut of a part in which all edges span at most two places, by dynamic programming."""
    n = len(caps)
    pay = [((0.0, c) if c > 0 else (-c, 0.0)) for c in caps]  # (cost if furniture, cost if article)
    cost = {(1, x): pay[0][1 - x] for x in (0, 1)}
    back: list[dict] = []
    for i in range(1, n):
        new, came = {}, {}
        one, two = edges.get((i - 1, i), 0.0), edges.get((i - 2, i), 0.0)
        for (y, x), v in cost.items():
            for z in (1, 0):
                w = v + pay[i][1 - z] + one * (x != z) + (two * (y != z) if i > 1 else 0.0)
                if (x, z) not in new or w < new[x, z]:
                    new[x, z], came[x, z] = w, y
        back.append(came)
        cost = new
    state = min(cost, key=lambda s: (cost[s], s))
    out = [state[1]]
    for came in reversed(back):
        out.append(state[0])
        state = (came[state], state[0])
    return [bool(x) for x in reversed(out)][-n:]


def cut_labels(costs: list[float], near: list[float], apart: list[float]) -> list[bool]:
    """Minimum-cut labels of a page; ``near[i]`` joins lines i and i+1, ``apart[i]`` lines i and i+2. True is furniture.

    Nodes whose capacity is above all their open edges are fixed first, which never changes the minimum, and hand what
    their edges carry to their neighbours; the flow runs over what stays undecided.
    """
    n = len(costs)
    caps = list(costs)
    links: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for i, w in enumerate(near):
        links[i].append((i + 1, w))
        links[i + 1].append((i, w))
    for i, w in enumerate(apart):
        links[i].append((i + 2, w))
        links[i + 2].append((i, w))
    total = [sum(w for _, w in own) for own in links]
    label: list[bool | None] = [None] * n
    ready = [i for i in range(n) if abs(caps[i]) > total[i]]
    while ready:
        i = ready.pop()
        if label[i] is not None:
            continue
        label[i] = x = caps[i] > 0
        for j, w in links[i]:
            if label[j] is None:
                caps[j] += w if x else -w
                total[j] -= w
                if abs(caps[j]) > total[j]:
                    ready.append(j)
    if None not in label:
        return label
    # parts of undecided lines: they are runs, as edges span at most two places
    parts: list[list[int]] = []
    for i in (i for i in range(n) if label[i] is None):
        if parts and i - parts[-1][-1] <= 2:
            parts[-1].append(i)
        else:
            parts.append([i])
    for part in parts:
        place = {i: k for k, i in enumerate(part)}
        own = {(place[i], place[j]): w for i in part for j, w in links[i] if i < j and j in place}
        solve = _chain_labels if len(part) > LONG_PART else _flow_labels
        for i, x in zip(part, solve([caps[i] for i in part], own)):
            label[i] = x
    return label


# --- the fitted model ----------------------------------------------------------------------------------------------


def _gaps(numbers: list[int], prose: list[bool]) -> list[int]:
    """Kind of nearness of two lines in a row: 0 next to each other, 1 across a blank line, 2 across more; plus 3 where prose is one of them."""
    return [min(j - i - 1, 2) + 3 * (a or b) for i, j, a, b in zip(numbers, numbers[1:], prose, prose[1:])]


class _Weights(dict):
    """Weight of a word feature; forgotten beyond a bound."""

    def __init__(self, weights: list[float]):
        self.weights = weights

    def __missing__(self, w: str) -> float:
        if len(self) > 400_000:
            self.clear()
        x = self[w] = self.weights[_bucket(w)]
        return x


class Model:
    """Weights of the classifier and of the edges; small, of one size, and sent to every task."""

    def __init__(self, weights: np.ndarray, bias: float, near: list[float], apart: float):
        self.weights, self.bias, self.near, self.apart = weights, float(bias), near, apart
        self.shape = weights[:SHAPES].tolist()
        self.words: _Weights | None = None
        self.lines: dict[str, float] = {}

    def __reduce__(self):
        return Model, (self.weights.astype(np.float32), self.bias, self.near, self.apart)

    def words_odds(self, s: str) -> float:
        x = self.lines.get(s)
        if x is None:
            if self.words is None:
                self.words = _Weights(self.weights.tolist())
            own = _words(s)
            x = sum(map(self.words.__getitem__, own)) / math.sqrt(len(own))
            if len(s) < 60:
                if len(self.lines) > 100_000:
                    self.lines.clear()
                self.lines[s] = x
        return x

    def odds(self, shapes: list[int], s: str) -> float:
        """Log odds of furniture but for the counts."""
        return self.bias + sum(map(self.shape.__getitem__, shapes)) + self.words_odds(s)

    def count_odds(self, count: tuple | None) -> float:
        return sum(map(self.shape.__getitem__, count_ids(count)))

    def labels(self, numbers: list[int], prose: list[bool], odds: list[float]) -> list[bool]:
        return cut_labels(odds, [self.near[g] for g in _gaps(numbers, prose)], [self.apart] * max(len(odds) - 2, 0))


def _fit(rows: np.ndarray, ids: np.ndarray, values: np.ndarray, n: int, y: np.ndarray, weight: np.ndarray, steps: int = 40) -> tuple[np.ndarray, float]:
    """Logistic regression by full-batch adaptive gradient steps; (weights, bias)."""
    used, ids = np.unique(ids, return_inverse=True)
    w, b = np.zeros(len(used)), 0.0
    seen, seen_b = np.full(len(used), 1e-6), 1e-6
    total = weight.sum()
    for _ in range(steps):
        z = np.bincount(rows, w[ids] * values, n) + b
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        gw = np.bincount(ids, g[rows] * values, len(used)) + 3e-5 * total * w * 0.1
        gb = g.sum()
        seen += gw * gw
        seen_b += gb * gb
        w -= 0.6 * gw / np.sqrt(seen)
        b -= 0.6 * gb / math.sqrt(seen_b)
    out = np.zeros(BUCKETS)
    out[used] = w
    return out, b


def _agreement(pages: list[tuple], labels: list[list[bool]]) -> tuple[list[float], float]:
    """Edge weights: half the log odds that neighbours agree, by their distance; lines two apart come last."""
    same, other = [1.0] * 7, [1.0] * 7
    for (numbers, _, prose, *_), own in zip(pages, labels):
        for g, x, y in zip(_gaps(numbers, prose), own, own[1:]):
            same[g] += x == y
            other[g] += x != y
        for x, y in zip(own, own[2:]):
            same[6] += x == y
            other[6] += x != y
    w = [min(max(0.5 * math.log(s / o), 0.1), 2.0) for s, o in zip(same, other)]
    return w[:6], w[6] / 3


def fit(sample: list[tuple[str, dict[int, tuple[int, int, int, int]]]]) -> Model:
    """A model from (text, counts by line number) of the sampled pages."""
    pages = []
    for text, counts in sample:
        numbers, lines, stripped, prose = page_lines(text)
        if numbers:
            pages.append((numbers, stripped, prose, page_shapes(numbers, lines, stripped, prose), [counts.get(i) for i in numbers]))
    n = sum(len(p[0]) for p in pages)
    empty = Model(np.zeros(BUCKETS), -1.0, [0.1] * 6, 0.1)
    if not n:
        return empty
    rows, ids, values = [], [], []
    y, known = np.zeros(n), np.zeros(n)
    templates = _templates(pages)
    r = 0
    buckets = _Weights(list(range(BUCKETS)))
    for numbers, stripped, prose, shapes, counts in pages:
        inside = [any(prose[:k]) and any(prose[k:]) for k in range(len(prose))]
        for k, s in enumerate(stripped):
            own, words = shapes[k] + count_ids(counts[k]), [buckets[w] for w in _words(s)]
            rows += [r] * (len(own) + len(words))
            ids += own + words
            values += [1.0] * len(own) + [1 / math.sqrt(len(words))] * len(words)
            known[r], y[r] = _example(s, counts[k], shapes[k], prose[k], inside[k], templates)
            r += 1
    if not y.any() or known.sum() == y.sum():
        return empty
    arrays = np.array(rows), np.array(ids), np.array(values)
    near, apart = [1.2, 0.5, 0.3, 0.8, 0.4, 0.2], 0.3
    given_y, given = y.copy(), known > 0
    for no in range(ROUNDS):
        w, b = _fit(*arrays, n, y, known)
        last = no + 1 == ROUNDS
        z = np.bincount(arrays[0], w[arrays[1]] * arrays[2], n) + b
        if not last:
            # lines that are no examples have no say of their own yet: their neighbours decide
            z = np.where(given, np.where(given_y > 0, np.maximum(z, 2.0), np.minimum(z, -2.0)), np.clip(z, -UNSURE[no], UNSURE[no]))
        model = Model(w, b, near, apart)
        labels, r = [], 0
        for page in pages:
            m = len(page[0])
            labels.append(model.labels(page[0], page[2], z[r : r + m].tolist()))
            r += m
        if not last:
            cut = np.array([x for own in labels for x in own], dtype=float)
            y = np.where(given, given_y, cut)
            known = np.where(given, 1.0, 0.5)  # what only the cut says counts less than the examples
    near, apart = _agreement(pages, labels)
    return Model(w, b, near, apart)


#: In the first rounds the odds of lines that are no examples are cut to this.
UNSURE = (0.4, 2.0)
ROUNDS = 3


def _openings(s: str) -> list[str]:
    """The first word of a line and its first two, digits apart."""
    words = [w if not w.isdigit() else "0" for w in TOKEN.findall(s.lower())[:2]]
    return [words[0], " ".join(words)] if words else []


def _ending(s: str) -> str:
    """The last three words of a line, marked so that they never equal an opening."""
    return " ".join(w if not w.isdigit() else "0" for w in TOKEN.findall(s.lower())[-3:]) + "$"


def _templates(pages: list[tuple]) -> dict[str, float]:
    """What at least ``OPENINGS`` lines share: openings of lines that are neither prose nor list items, with the share
    that stands right above prose, and endings of prose."""
    seen: dict[str, list[int]] = {}
    for numbers, stripped, prose, *_ in pages:
        for s, p, lead in zip(stripped, prose, leads(numbers, prose)):
            if p:
                seen.setdefault(_ending(s), [0, 0])[0] += 1
            elif not LIST_MARK.match(s):
                for o in _openings(s):
                    x = seen.setdefault(o, [0, 0])
                    x[0] += 1
                    x[1] += lead
    return {o: above / n for o, (n, above) in seen.items() if n >= OPENINGS}


OPENINGS = 8


def _example(s: str, count: tuple | None, shapes: list[int], prose: bool, inside: bool, templates: dict[str, float]) -> tuple[float, float]:
    """(1 if the line is an example, 1 if of furniture) from what a page is, without any given word."""
    _, everywhere, pages, _, leading = count or (1, 1, 1, 1, 0)
    if 37 in shapes:
        return 1.0, 0.0  # a trail names it: the headline
    if 36 in shapes:
        return 1.0, 1.0  # the trail that ends with it
    if LIST_MARK.match(s):
        return float(inside), 0.0
    if everywhere >= 4 and leading * 4 >= 3 * pages:
        return 1.0, 0.0  # a usual heading
    if everywhere >= (12 if prose else 4) and everywhere * 3 >= pages:
        return 1.0, 1.0
    if prose:
        return float(everywhere == 1 and _ending(s) not in templates), 0.0
    share = next((templates[o] for o in reversed(_openings(s)) if o in templates), None)
    if share is not None and (share > 0.75 or share < 0.5):
        return 1.0, float(share < 0.5)
    return 0.0, 0.0


# --- over the collection -------------------------------------------------------------------------------------------


def _pages(records: DataFrame) -> DataFrame:
    """(page, site, gram, nos, keys, leads): for each page the least hash of its substrings, and its lines with their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_batches(iter([batch])):
                points, offsets = code_points(texts)
                hashes = Rolling(points).every(PAGE_GRAM)
                grams, nos, keys, above = [], [], [], []
                for k, t in enumerate(texts):
                    a, b = int(offsets[k]), int(offsets[k + 1])
                    own = hashes[a : max(b - PAGE_GRAM + 1, a)]
                    grams.append(int(own.min()) - (1 << 63) if len(own) else line_key(t))
                    numbers, _, stripped, prose = page_lines(t)
                    nos.append(numbers)
                    keys.append([line_key(s) for s in stripped])
                    above.append(leads(numbers, prose))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(grams, pa.int64()), pa.array(nos, pa.list_(pa.int32())), pa.array(keys, pa.list_(pa.int64())), pa.array(above, pa.list_(pa.bool_()))],
                    names=["page", "site", "gram", "nos", "keys", "leads"],
                )

    schema = "page bigint, site bigint, gram bigint, nos array<int>, keys array<bigint>, leads array<boolean>"
    return records.select("page", "site", "text").mapInArrow(run, schema)


def _counts(pages: DataFrame) -> DataFrame:
    """(page, counts): of each page the lines that stand on another page too, with their counts.

    Counting is by two partial aggregations. (site, line) pairs on ``HOT_SHARE`` of all lines are at most 1 / ``HOT_SHARE``
    and go to every task; the others are joined by shuffle, where none of them is hot.
    """
    lines = pages.select("page", "site", "gram", F.explode(F.arrays_zip("nos", "keys", "leads")).alias("x"))
    lines = lines.select("page", "site", "gram", F.col("x.nos").alias("no"), F.col("x.keys").alias("line"), F.col("x.leads").cast("int").alias("lead"))
    # a page counts a line once; repeated deliveries are one page
    different = lines.groupBy("line", "site", "gram", "page").agg(F.max("lead").alias("lead")).groupBy("line", "site", "gram").agg(F.count("*").alias("pages"), F.sum("lead").alias("leading"))
    by_site = different.groupBy("line", "site").agg(F.count("*").alias("here"), F.sum("pages").alias("own"), F.sum("leading").alias("own_leading"))
    sums = [F.sum("here").alias("everywhere"), F.sum("own").alias("pages"), F.count("*").alias("sites"), F.sum("own_leading").alias("leading")]
    by_line = by_site.groupBy("line").agg(*sums).where("pages > 1")
    count = F.struct(*[F.col(c).cast("int").alias(c) for c in ("here", "everywhere", "pages", "sites", "leading")])
    table = checkpointed(by_site.join(by_line, "line").select("line", "site", "own", count.alias("count")))
    n_lines = pages.agg(F.sum(F.size("keys"))).first()[0] or 0
    hot = table.where(F.col("own") >= max(n_lines * HOT_SHARE, 2)).drop("own")
    cold = table.where(F.col("own") < max(n_lines * HOT_SHARE, 2)).drop("own")
    first = lines.select("page", "site", "no", "line").join(F.broadcast(hot), ["line", "site"], "left")
    found = first.where("count is not null").select("page", "no", "count")
    rest = first.where("count is null").drop("count").join(cold, ["line", "site"]).select("page", "no", "count")
    return found.union(rest).groupBy("page").agg(F.collect_set(F.struct("no", "count")).alias("counts"))


def _sampled(records: DataFrame, counts: DataFrame) -> list[tuple[str, dict]]:
    """Texts and counts of the ``SAMPLE_PAGES`` pages whose hashes of the id are least."""
    order = F.xxhash64("page", F.lit(7))
    chosen = records.select("page").distinct().orderBy(order).limit(SAMPLE_PAGES)
    rows = records.join(F.broadcast(chosen), "page").groupBy("page").agg(F.first("text").alias("text")).join(counts.join(F.broadcast(chosen), "page"), "page", "left").orderBy("page").collect()
    return [(r["text"], {x["no"]: tuple(x["count"]) for x in r["counts"] or []}) for r in rows]


def _with_page(df: DataFrame) -> DataFrame:
    """(id, page, site, text) of (id, text) and perhaps ``site``, whose case does not count."""
    site = F.xxhash64(F.lower(F.trim("site"))) if "site" in df.columns else F.lit(0).cast("bigint")
    return df.where("id is not null and text is not null").select("id", F.xxhash64("id").alias("page"), site.alias("site"), "text")


def labelled(df: DataFrame, extra: Callable[[str, list[str]], list[int]] | None = None, judge: Callable[[list[int], list[bool]], bool] | None = None) -> DataFrame:
    """(id, furniture array<int>, judged boolean) for each record of (id, text[, site]) with a line.

    ``extra(text, stripped lines)`` gives whole numbers, made where the text is; ``judge(these, labels)`` decides about the
    page when its lines have labels. So texts are never shuffled.
    """
    records = _with_page(df)
    counts = checkpointed(_counts(checkpointed(_pages(records))))
    model = records.sparkSession.sparkContext.broadcast(fit(_sampled(records, counts)))

    def odds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for part, texts in text_batches(iter([batch])):
                nos, proses, values, extras = [], [], [], []
                for t in texts:
                    numbers, lines, stripped, prose = page_lines(t)
                    nos.append(numbers)
                    proses.append(prose)
                    values.append([m.odds(own, s) for own, s in zip(page_shapes(numbers, lines, stripped, prose), stripped)])
                    extras.append(extra(t, stripped) if extra else [])
                ints = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(nos, ints), pa.array(proses, pa.list_(pa.bool_())), pa.array(values, pa.list_(pa.float32())), pa.array(extras, ints)],
                    names=["id", "page", "nos", "prose", "odds", "extras"],
                )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        plain = m.count_odds(None)
        for batch in batches:
            ids, found, judged = [], [], []
            for key, nos, prose, values, extras, counts_ in zip(*[batch.column(k).to_pylist() for k in range(6)]):
                if not nos:
                    continue
                more = {x["no"]: m.count_odds(tuple(x["count"].values())) for x in counts_ or []}
                own = m.labels(nos, prose, [v + more.get(no, plain) for no, v in zip(nos, values)])
                ids.append(key)
                found.append([no for no, x in zip(nos, own) if x])
                judged.append(judge(extras, own) if judge else False)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(found, pa.list_(pa.int32())), pa.array(judged, pa.bool_())], names=["id", "furniture", "judged"])

    lines = records.select("id", "page", "text").mapInArrow(odds, "id string, page bigint, nos array<int>, prose array<boolean>, odds array<float>, extras array<int>")
    once = lines.groupBy("page").agg(F.first(F.struct("id", "nos", "prose", "odds", "extras")).alias("x")).select("page", "x.*")
    joined = once.join(counts, "page", "left").select("id", "nos", "prose", "odds", "extras", "counts")
    return joined.mapInArrow(cut, "id string, furniture array<int>, judged boolean")


def furniture(df: DataFrame, extra: Callable | None = None, skip: Callable | None = None) -> DataFrame:
    """(id, line_no) of the furniture lines of (id, text[, site]); records that ``skip`` judges true have no rows."""
    return labelled(df, extra, skip).where("not judged").select("id", F.explode("furniture").alias("line_no"))
