"""Problem 2: sentence units with code-point offsets, by a hidden-event n-gram model.

Between two words stands either nothing or the hidden event "boundary". The model is an n-gram model over words, marks and
events: the event depends on the word before it and its mark, the word after it on the event (and, without one, on the word before),
and an event on the event before it and how many words lie between. So the log odds of a gap are those of its mark,
of the word before and of the word after, each with back-off to its class; the forward-backward recursion over all gaps of
a line adds what neighbouring events say, and a boundary stands where its posterior exceeds one half.

No abbreviations are given. Counts come from all records (``counted_model``): ends of lines are
known boundaries, so words and marks with an event are counted at the ends and starts of lines, transitions between
them; words and marks without an event are what remains of the gaps inside lines, by expectation maximisation. A
word that is often followed by a mark inside lines and never ends one is thereby an abbreviation. In Thai the gaps are blanks
between two Thai letters, the words beside them are told by their length. Priors of a few counts keep small collections sane.

A gap inside an open quotation or parenthesis is none, nor is a mark inside a number, name or address (no blank after it).

Cases: a newline always ends a unit; null, empty and blank texts have none; blanks around a unit are left out, so every
unit has at least one visible character; repeated records give their units once; without records the priors decide.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, checkpointed, text_batches

ROUNDS = 8
#: Gaps of a block, expected counts are whole numbers of 1 / ONE, and longer lines are done one by one.
BLOCK_GAPS, ONE, LONG_LINE = 100_000, 1 << 30, 256
#: A word before or after a gap that was seen so often has half a say of its own, the rest is its class's.
SHRINK, SHRINK_AFTER = 6.0, 25.0
#: Log odds of a gap, and what the event before adds to them, stay within these.
MOST, MOST_AFTER = 7.0, 0.8

STOPS = ".!?…。！？।॥؟"
CLOSERS = "\"'”’»」』)）]】›"
OPENERS = "“«「『(（[【„‹¿¡"
#: Every place where something may happen: line ends, marks with their closers, quotes and brackets, blanks between Thai letters.
EVENT = re.compile(r"\n|[.!?…。！？।॥؟]+|[“”„«»「」『』()（）\[\]【】‹›\"]|(?<=[฀-๿])[  ]+(?=[฀-๿])")
PAIR = {"”": "“", "»": "«", "」": "「", "』": "『", ")": "(", "）": "（", "]": "[", "】": "【", "›": "‹"}
CJK = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")
#: Where a word begins that ends before a mark.
WORD_EDGE = frozenset(" \t\n\r  　“”„«»「」『』()（）[]\"'¿¡、，,;:：；/।。！？!?…")
FIRST_WORD = re.compile(r"[^\W\d_]+|\d+")
NEXT_THAI = re.compile(r"\n|(?<=[฀-๿])[  ]+(?=[฀-๿])")
#: A clause of saying that closes right after a quotation, in a script without capitals.
SAID_CJK = re.compile(r"[^。！？\n“”「」：，]{0,24}?(?:说|道|問|问|喊|答)[。，]")
#: What may close an open quotation or parenthesis.
CLOSING = {"“": "”", "«": "»", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "【": "】", "„": "“”\"", "‹": "›", '"': '"'}
LOW_NEXT = re.compile(r"[„“”\n]")


def _never_closed(text: str, opened: tuple[str, bool], at: int) -> bool:
    """Whether the open quotation or parenthesis has no closing mark in the rest of its line."""
    end = text.find("\n", at)
    return all(text.find(close, at, end if end >= 0 else len(text)) < 0 for close in CLOSING[opened[0]])


def _closes_low(text: str, at: int) -> bool:
    """Whether the straight mark closes an open low mark, which has no curved closing mark of its own in the line."""
    m = LOW_NEXT.search(text, at + 1)
    return m is None or m[0] in "„\n"


def _raw_before(text: str, at: int, line_start: int) -> str:
    a = at
    while a > line_start and text[a - 1] not in WORD_EDGE:
        a -= 1
    return text[a:at]


def _word_before(text: str, at: int, line_start: int) -> tuple[str, str]:
    """(word, class) before a full stop."""
    w = _raw_before(text, at, line_start)
    a = at - len(w)
    if not w:
        return "", "none"
    if w[-1].isdigit():
        if not text[line_start:a].strip("-*•– \t"):
            return "<item>", "item"
        return ("<number>", "number") if at - a > 2 else ("<ordinal>", "ordinal")
    if CJK.match(w[-1]):
        return w[-1], "cjk"
    low = w.lower()
    if len(w) == 1:
        return low, "initial"
    if "." in w:
        return low, "dotted" if len(w) <= 7 else "name"
    if not w[0].isupper() and not w[0].islower():
        return low, "letters" if len(w) > 2 else "letters2"
    return low, ("capital" if w[0].isupper() else "small") + ("4" if len(w) <= 4 else "")


def _word_after(text: str, k: int) -> tuple[str, str]:
    """(word, class) at ``k``, the first place after a gap that is not blank."""
    c = text[k]
    if c.isdigit():
        return "<number>", "number"
    if c.isalpha():
        if CJK.match(c):
            return ("<said>", "said") if SAID_CJK.match(text, k) else (c, "letter")
        w = FIRST_WORD.match(text, k)
        w = w[0] if w else c
        return w, "capital" if c.isupper() else "small" if c.islower() else "letter"
    if c in OPENERS or c == '"':
        return c, "opening"
    if c in ",;:，；：、،؛—–-":
        return c, "mark"
    return c, "letter" if ord(c) > 0x8FF else "other"


def _length_class(n: int) -> str:
    return "short" if n <= 14 else "middle" if n <= 22 else "long"


def _far(text: str, a: int, b: int) -> int:
    """Class of the number of words between two gaps."""
    n = text.count(" ", a, b) + 1
    if n < 4 and b - a > 12 and text[b - 2] >= "぀":
        n = (b - a) // 3
    return min(n, 4) if n < 7 else 5


#: One gap: (place, mark, word before, its class, word after, its class, words since the last gap, both words as they stand).
Gap = tuple[int, str, str, str, str, str, int, str]


def lines_of(text: str, phrases: bool = False) -> Iterator[tuple[list[Gap], int, tuple | None, tuple | None]]:
    """(gaps, end, (mark, word, class) of a closing mark, (word, class) of the first word) for each line of a text.

    Both words as they stand, and the first words of lines, are only needed for estimation, and made if ``phrases``.
    """
    n = len(text)
    line_start, since = 0, 0
    stack: list[tuple[str, bool]] = []  # (opener, at the start of a sentence)
    gaps: list[Gap] = []
    closing = None
    skip_to = -1

    def starts_unit(at: int) -> bool:
        k = at
        while k > line_start and text[k - 1].isspace():
            k -= 1
        end = k
        while k > line_start and text[k - 1] in CLOSERS:
            k -= 1
        return end == line_start or k > line_start and text[k - 1] in STOPS

    def opening() -> tuple | None:
        k = line_start
        while k < n and text[k] != "\n" and text[k].isspace():
            k += 1
        if k >= n or text[k] == "\n":
            return None
        after = _word_after(text, k)
        # in scripts without capitals the word after says less; they are counted apart
        return (after[0], "uncased " + after[1]) if closing and (closing[0][0] in "。！？।؟" or closing[2].startswith("uncased") or not after[0].isascii() and after[1] == "letter") else after

    for m in EVENT.finditer(text):
        at = m.start()
        if at < skip_to:
            continue
        c = text[at]
        if c == "\n":
            yield gaps, at, closing, opening() if closing and phrases else None
            line_start = since = at + 1
            stack.clear()
            gaps, closing = [], None
            continue
        if c in STOPS:
            end = m.end()
            j = end
            closed = None
            # closers that belong to this mark
            while j < n and text[j] in CLOSERS:
                q = text[j]
                if q == '"':
                    if stack and stack[-1][0] == "„" and _closes_low(text, j):
                        closed = stack.pop()
                    elif stack and stack[-1][0] == '"':
                        closed = stack.pop()
                    else:
                        break
                elif q not in "'’":
                    want = PAIR.get(q)
                    if stack and (stack[-1][0] == want or (q in "”“" and stack[-1][0] == "„")):
                        closed = stack.pop()
                    elif want is not None:
                        break
                j += 1
            # French guillemets keep a blank before the closing mark
            if j == end and j + 1 < n and text[j] in "   " and text[j + 1] == "»" and stack and stack[-1][0] == "«":
                closed = stack.pop()
                j += 2
            skip_to = j
            while stack and _never_closed(text, stack[-1], j):
                stack.pop()
            if stack:
                continue  # inside a quotation or parenthesis
            # kind of the mark: its sign, what it closes
            run = text[at:end]
            sign = "…" if "…" in run or run.startswith("..") else "।" if c in "।॥" else c
            if sign == "…" and run.strip("….") != "":
                sign = run.strip("….")[0]
            mark = sign
            if closed:
                mark += ("(" if closed[0] in "(（[【" else "“") + ("^" if closed[1] else "-")
            word = _word_before(text, at, line_start) if sign == "." and not closed else ("", "none")
            k = j
            while k < n and text[k] != "\n" and text[k].isspace():
                k += 1
            if k >= n or text[k] == "\n":
                closing = (mark, word[0], "uncased " + word[1] if word[1].startswith("letters") else word[1])
                continue
            wide = c in "。！？" or CJK.match(text[j]) is not None and j > end or sign == "…" and at > 0 and CJK.match(text[at - 1]) is not None
            if k == j:
                if not wide and c not in "।॥؟" and not (closed and sign in "!?"):
                    continue  # a mark inside a number, a name or an address
                mark += "_" if sign == "…" else ""
            after = _word_after(text, k)
            if wide or sign in "।؟" or word[1].startswith("letters") or not after[0].isascii() and after[1] == "letter":
                # scripts without capitals are counted apart
                after = after[0], "uncased " + after[1]
                word = word if word[1] == "none" else (word[0], "uncased " + word[1])
                mark += "~"
            gaps.append((j, mark, *word, *after, _far(text, since, at), f"{_raw_before(text, at, line_start)} {text[k : k + 6]}" if phrases else ""))
            since = k
            continue
        if c in "“«「『(（[【„‹":
            if c == "“" and stack and stack[-1][0] == "„":
                stack.pop()  # German closing mark
            else:
                stack.append((c, starts_unit(at)))
            continue
        if c == '"':
            if stack and (stack[-1][0] == '"' or (stack[-1][0] == "„" and _closes_low(text, at))):
                stack.pop()
            else:
                stack.append((c, starts_unit(at)))
            continue
        if c in PAIR:
            if stack and (stack[-1][0] == PAIR[c] or (c == "”" and stack[-1][0] == "„")):
                stack.pop()
            continue
        # a blank between two Thai letters
        if stack:
            continue
        nxt = NEXT_THAI.search(text, m.end())
        left = _length_class(at - max(since, line_start))
        right = _length_class((nxt.start() if nxt else n) - m.end())
        gaps.append((at, "ก", left, left, right, "thai " + right, 5, ""))
        since = m.end()
    yield gaps, n, closing, opening() if closing and phrases else None


#: Counts without and with an event of a mark without a prior of its own: one that closes a quotation or parenthesis.
UNKNOWN_MARK = [1.0, 3.0]
#: Counts without an event for pieces of Thai by their length; with one there are two.
THAI_PRIOR = {"short": 4.0, "middle": 0.3, "long": 0.1}


class Model:
    """Counts with and without an event, turned to log odds."""

    def __init__(self):
        # sides: [without an event, with one]; a few prior counts each
        self.marks = {".": [2.0, 6.0], "!": [0.5, 6.0], "?": [0.5, 6.0], "。": [0.3, 8.0], "！": [0.3, 6.0], "？": [0.3, 6.0], "।": [0.3, 8.0], "؟": [0.3, 6.0], "…": [2.0, 3.0], "…_": [8.0, 1.0]}
        self.left_class = {"initial": [4.0, 0.0], "item": [8.0, 0.0], "dotted": [2.0, 0.0], "ordinal": [2.0, 1.0], "small": [0.0, 4.0], "capital": [0.0, 2.0], "uncased letters": [0.0, 4.0]}
        self.right_class = {"small": [20.0, 0.0], "mark": [20.0, 0.0], "said": [20.0, 0.0], "number": [1.0, 0.0], "capital": [2.0, 20.0], "opening": [2.0, 100.0]}
        self.right_class |= {"uncased mark": [20.0, 0.0], "uncased said": [20.0, 0.0], "uncased letter": [2.0, 20.0]}
        self.left: dict[tuple[str, str], list[float]] = {}
        self.right: dict[tuple[str, str], list[float]] = {}
        self.pair, self.class_pair = Counter(), Counter()  # (word or class before, class after) without an event
        self.thai = {(a, b): [THAI_PRIOR[a] + THAI_PRIOR[b], 2.0] for a in THAI_PRIOR for b in THAI_PRIOR}
        self.prior = [1.0, 4.0]
        self.after = {(e, d): 0.0 for e in (0, 1) for d in range(6)}
        self._odds: dict[tuple, float] = {}
        self.finish()

    def see(self, side: int, w: float, left: str, left_class: str, right: str | None, right_class: str | None) -> None:
        if left_class != "none":
            own = self.left.setdefault((left_class, left), [0.0, 0.0])
            self.left_class.setdefault(left_class, [0.0, 0.0])[side] += w
            own[side] += w
        if right_class:
            self.right_class.setdefault(right_class, [0.0, 0.0])[side] += w
            self.right.setdefault((right_class, right), [0.0, 0.0])[side] += w

    def finish(self) -> Model:
        def totals(classes: dict, keep: str = "") -> list[float]:
            return [sum(v[k] for c, v in classes.items() if c.startswith("uncased") == bool(keep)) for k in (0, 1)]

        self.seen_before = Counter()
        for (left, _), w in [*self.pair.items(), *self.class_pair.items()]:
            self.seen_before[left] += w
        self.left_total = totals(self.left_class), totals(self.left_class, "uncased")
        self.right_total = totals(self.right_class), totals(self.right_class, "uncased")
        self._odds = {}
        return self

    @staticmethod
    def _likelier(own: list[float], total: list[float], pool: float) -> float:
        """Log of how much likelier something is with an event; the counts of both sides are pooled by ``pool`` of them."""
        q = (own[0] + own[1] + 0.1) / (total[0] + total[1] + 1.0)
        return math.log((own[1] + pool * q) / (total[1] + pool)) - math.log((own[0] + pool * q) / (total[0] + pool))

    def _word(self, words: dict, classes: dict, cls: str, word: str, shrink: float) -> float:
        """What a word says beyond its class, by how often it was seen."""
        own = words.get((cls, word))
        if own is None:
            return 0.0
        seen = own[0] + own[1]
        return max(-5.0, min(5.0, self._likelier(own, classes[cls], 10.0))) * seen / (seen + shrink)

    def mark_odds(self, mark: str) -> float:
        no, yes = self.marks.get(mark) or self.marks.get(mark.rstrip("~"), UNKNOWN_MARK)
        return math.log(yes / no)

    def left_odds(self, cls: str, word: str) -> float:
        return self._likelier(self.left_class.get(cls, [0.0, 0.0]), self.left_total[cls.startswith("uncased")], 4.0) + self._word(self.left, self.left_class, cls, word, SHRINK)

    def right_odds(self, cls: str, word: str) -> float:
        return self._likelier(self.right_class.get(cls, [0.0, 0.0]), self.right_total[cls.startswith("uncased")], 4.0) + self._word(self.right, self.right_class, cls, word, SHRINK_AFTER)

    def usual_odds(self, before: str, left: str | None, right_class: str) -> float:
        """Without an event the word after depends on the word before, and for rare ones on its class."""
        usual = (self.right_class.get(right_class, [0.0, 0.0])[0] + 0.5) / (self.right_total[right_class.startswith("uncased")][0] + 5.0)
        by_class = (self.class_pair[before, right_class] + 4 * usual) / (self.seen_before[before] + 4.0)
        by_word = (self.pair[left, right_class] + 4 * by_class) / (self.seen_before[left] + 4.0) if left is not None else by_class
        return math.log(by_word / usual)

    def gap_odds(self, gap: Gap) -> float:
        key = gap[1:6]
        x = self._odds.get(key)
        if x is None:
            mark, left, left_class, right, right_class = key
            if mark == "ก":
                no, yes = self.thai[left, right]
                return math.log(yes / no)
            x = self.mark_odds(mark) + self.right_odds(right_class, right) - self.usual_odds(mark if left_class == "none" else left_class, left if left_class != "none" else None, right_class)
            if left_class != "none":
                x += self.left_odds(left_class, left)
            x = max(-MOST, min(MOST, x))
            if len(self._odds) > 200_000:
                self._odds.clear()
            self._odds[key] = x
        return x


    def stop_odds(self, text: str, at: int, line_start: int) -> float:
        """Log odds that the full stop at ``at``, which nothing follows, ends a sentence and not an abbreviation."""
        word, cls = _word_before(text, at, line_start)
        if cls in ("none", "item", "cjk", "number", "ordinal"):
            return MOST
        cls = "uncased " + cls if cls.startswith("letters") else cls
        no, yes = self.marks["."]
        of_class = self._likelier(self.left_class.get(cls, [0.0, 0.0]), self.left_total[cls.startswith("uncased")], 4.0)
        return math.log(yes / no) + of_class + self._word(self.left, self.left_class, cls, word, SHRINK)

    def decide(self, gaps: list[Gap]) -> list[float]:
        """Posterior of an event in each gap of a line."""
        known, out = self._odds, []
        for g in gaps:
            x = known.get(g[1:6])
            out.append(self.gap_odds(g) if x is None else x)
        return posteriors(out, [g[6] for g in gaps], self.after)


def posteriors(odds: list[float], far: list[int], after: dict[tuple[int, int], float]) -> list[float]:
    """P(event) in each gap of a line by forward-backward; a line starts with an event. ``after[e, d]`` is added to the log odds
    of an event ``d`` words after the gap before, which has one (e = 1) or not."""
    n = len(odds)
    w0 = [math.exp(o + after[0, d]) for o, d in zip(odds, far)]
    w1 = [math.exp(o + after[1, d]) for o, d in zip(odds, far)]
    a, b = 0.0, 1.0
    fwd = []
    for i in range(n):
        no, yes = a + b, a * w0[i] + b * w1[i]
        s = no + yes
        a, b = no / s, yes / s
        fwd.append((a, b))
    out = [0.0] * n
    a, b = 1.0, 1.0
    for i in range(n - 1, -1, -1):
        f0, f1 = fwd[i]
        out[i] = f1 * b / (f0 * a + f1 * b)
        a, b = a + w0[i] * b, a + w1[i] * b
        s = a + b
        a, b = a / s, b / s
    return out


def _settled(new: Model, start: Model, seen: dict | None) -> Model:
    """The model of a round from its counts; ``seen`` are those of events after events."""
    if seen:
        usual = math.log(new.prior[1] / new.prior[0])
        new.after = {k: max(-MOST_AFTER, min(MOST_AFTER, math.log(y / x) - usual)) for k, (x, y) in seen.items()}
    for mark, own in new.marks.items():
        # the prior keeps most of its say: where words tell nothing, the recursion must not talk itself into one side
        no_, yes_ = start.marks.get(mark.rstrip("~"), UNKNOWN_MARK)
        share = 0.8 * yes_ / (no_ + yes_) + 0.2 * own[1] / (own[0] + own[1])
        own[:] = [1 - share, share]
    return new.finish()


def fit(texts: list[str]) -> Model:
    """A model from texts in memory; ``counted_model`` does the same over a table."""
    lines, start = [], Model()
    for t in texts:
        for gaps, _, closing, first in lines_of(t, True):
            if gaps:
                lines.append(gaps)
            if closing:
                start.see(1, 1.0, *closing[1:], *(first or (None, None)))
    model = start
    # before anything is known a mark is followed by an event as often as its prior says
    usual = {mark: yes / (no + yes) for mark, (no, yes) in start.marks.items()}
    post = [[usual.get(g[1].rstrip("~"), 0.7) for g in gaps] for gaps in lines]
    for no in range(ROUNDS):
        new = Model()
        for name in ("left_class", "left", "right_class", "right"):
            getattr(new, name).update({k: list(v) for k, v in getattr(start, name).items()})
        seen = {k: [5.0, 20.0] for k in new.after}
        known: set[str] = set()
        for gaps, own in zip(lines, post):
            before = 1.0
            for (_, mark, left, left_class, right, right_class, far, words), p in zip(gaps, own):
                q = 1 - p
                if mark == "ก":
                    if no:
                        new.thai[left, right][0] += q
                        new.thai[left, right][1] += p
                    before = p
                    continue
                if words not in known:
                    # two words with a mark between them count once: set phrases of furniture are no abbreviations
                    known.add(words)
                    new.see(0, q, left, left_class, right, right_class)
                    new.class_pair[mark if left_class == "none" else left_class, right_class] += q
                    if left_class != "none":
                        new.pair[left, right_class] += q
                if no:
                    own = new.marks.setdefault(mark, list(start.marks.get(mark.rstrip("~"), UNKNOWN_MARK)))
                    own[0] += q
                    own[1] += p
                    new.prior[0] += q
                    new.prior[1] += p
                    for e, w in ((0, 1 - before), (1, before)):
                        seen[e, far][0] += w * q
                        seen[e, far][1] += w * p
                before = p
        model = _settled(new, start, seen if no else None)
        post = [model.decide(gaps) for gaps in lines]
    return model


def units(text: str | None, model: Model) -> tuple[list[int], list[int]]:
    """(starts, ends) of the sentence units of a text."""
    starts: list[int] = []
    ends: list[int] = []
    if not text:
        return starts, ends
    a = 0

    def add(b: int) -> None:
        nonlocal a
        piece = text[a:b]
        left = piece.lstrip()
        if left:
            starts.append(b - len(left))
            ends.append(b - len(piece) + len(piece.rstrip()))
        a = b

    for gaps, end, _, _ in lines_of(text):
        if gaps:
            for g, p in zip(gaps, model.decide(gaps)):
                if p > 0.5:
                    add(g[0])
        add(end)
    return starts, ends


class Block:
    """The gaps of many lines as numbers, with the marks, words and pairs that they stand for.

    ``words`` has for each two words with a mark between them the gap of the block that may count.
    """

    def __init__(self):
        self.names: list[dict[tuple, int]] = [{} for _ in range(4)]  # marks, words before, words after, pairs; Thai pairs are words before
        self.ids: list[tuple[int, int, int, int, int]] = []
        self.lens: list[int] = []
        self.words: dict[str, tuple[int, int]] = {}  # two words -> (order, place)
        self.closings: Counter = Counter()

    def add(self, key: str, text: str) -> None:
        mark_no, left_no, right_no, pair_no = self.names
        record = xxhash.xxh64_intdigest(key.encode("utf-8", "surrogatepass"))
        for gaps, _, closing, first in lines_of(text, True):
            if closing:
                if closing[2] != "none":
                    self.closings["left", closing[2], closing[1]] += 1
                if first:
                    self.closings["right", first[1], first[0]] += 1
            if not gaps:
                continue
            self.lens.append(len(gaps))
            for at, mark, left, left_class, right, right_class, far, words in gaps:
                m = mark_no.setdefault((mark,), len(mark_no))
                if mark == "ก":
                    self.ids.append((m, left_no.setdefault(("ก", left, right), len(left_no)), -1, -1, far))
                    continue
                none = left_class == "none"
                pair = (mark, None, right_class) if none else (left_class, left, right_class)
                order = (record ^ at * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
                known = self.words.get(words)
                if known is None or order < known[0]:
                    self.words[words] = order, len(self.ids)
                self.ids.append((m, -1 if none else left_no.setdefault((left_class, left), len(left_no)), right_no.setdefault((right_class, right), len(right_no)), pair_no.setdefault(pair, len(pair_no)), far))

    def pack(self) -> bytes:
        return zlib.compress(pickle.dumps((np.array(self.ids, dtype=np.int32).reshape(-1, 5), np.array(self.lens, dtype=np.int32), [list(x) for x in self.names])), 1)


def _line_posteriors(odds: np.ndarray, far: np.ndarray, lens: np.ndarray, after: dict[tuple[int, int], float]) -> np.ndarray:
    """``posteriors`` of many lines at once, which stand after each other."""
    table = np.array([[after[e, d] for d in range(6)] for e in (0, 1)])
    w0, w1 = np.exp(odds + table[0][far]), np.exp(odds + table[1][far])
    starts = np.cumsum(lens) - lens
    out = np.zeros(len(odds))
    for k in np.flatnonzero(lens > LONG_LINE):
        s, e = int(starts[k]), int(starts[k] + lens[k])
        out[s:e] = posteriors(odds[s:e].tolist(), far[s:e].tolist(), after)
    order = np.argsort(-lens, kind="stable")
    order = order[lens[order] <= LONG_LINE]
    starts, lens = starts[order], lens[order]
    active = [int(np.searchsorted(-lens, -t)) for t in range(int(lens[0]) if len(lens) else 0)]  # lines longer than t
    fwd = np.zeros((len(odds), 2))
    a, b = np.zeros(len(lens)), np.ones(len(lens))
    for t, n in enumerate(active):
        at = starts[:n] + t
        no, yes = a[:n] + b[:n], a[:n] * w0[at] + b[:n] * w1[at]
        s = no + yes
        a[:n], b[:n] = no / s, yes / s
        fwd[at, 0], fwd[at, 1] = a[:n], b[:n]
    a, b = np.ones(len(lens)), np.ones(len(lens))
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at = starts[:n] + t
        x, y = a[:n].copy(), b[:n].copy()
        out[at] = fwd[at, 1] * y / (fwd[at, 0] * x + fwd[at, 1] * y)
        u, v = x + w0[at] * y, x + w1[at] * y
        s = u + v
        a[:n], b[:n] = u / s, v / s
    return out


def _expected(data: bytes, first: list[int], model: Model, no: int) -> Iterator[tuple[tuple, int, int]]:
    """((kind, x, y), without, with): expected counts of a block in one round, in units of 1 / ONE."""
    ids, lens, (marks, lefts, rights, pairs) = pickle.loads(zlib.decompress(data))
    if not len(ids):
        return
    mark, left, right, pair, far = ids.T
    thai = np.array([m == ("ก",) for m in marks])[mark]
    if no:
        mark_x = np.array([0.0 if m == "ก" else model.mark_odds(m) for (m,) in marks])
        left_x = np.array([math.log(model.thai[k[1:]][1] / model.thai[k[1:]][0]) if k[0] == "ก" else model.left_odds(*k) for k in lefts] + [0.0])
        right_x = np.array([model.right_odds(*k) for k in rights] + [0.0])
        pair_x = np.array([model.usual_odds(*k) for k in pairs] + [0.0])
        odds = mark_x[mark] + left_x[left] + right_x[right] - pair_x[pair]  # what is missing has number -1, the last
        p = _line_posteriors(np.where(thai, odds, np.clip(odds, -MOST, MOST)), far, lens, model.after)
    else:
        # before anything is known a mark is followed by an event as often as its prior says
        usual = {m: yes / (without + yes) for m, (without, yes) in model.marks.items()}
        p = np.array([usual.get(m.rstrip("~"), 0.7) for (m,) in marks])[mark]

    def summed(at: np.ndarray, w: np.ndarray, size: int) -> list[int]:
        return np.rint(np.bincount(at, np.rint(w * ONE), size)).astype(np.int64).tolist()

    counted = np.zeros(len(ids), dtype=bool)
    counted[first] = True
    q = 1 - p
    for kind, names, at in (("left", lefts, left), ("right", rights, right), ("pair", pairs, pair)):
        some = counted & (at >= 0)
        for k, x, any_ in zip(names, summed(at[some], q[some], len(names)), np.bincount(at[some], minlength=len(names)).tolist()):
            if any_:
                yield (kind, *k), x, 0
    if no:
        some = ~thai
        for (m,), x, y in zip(marks, summed(mark[some], q[some], len(marks)), summed(mark[some], p[some], len(marks))):
            if m != "ก":
                yield ("mark", m), x, y
        some = thai
        for k, x, y in zip(lefts, summed(left[some], q[some], len(lefts)), summed(left[some], p[some], len(lefts))):
            if k[0] == "ก":
                yield ("thai", *k[1:]), x, y
        before = np.r_[1.0, p[:-1]]
        before[np.cumsum(lens) - lens] = 1.0
        some = ~thai
        for e, w in ((0, 1 - before), (1, before)):
            for d, (x, y) in enumerate(zip(summed(far[some], (w * q)[some], 6), summed(far[some], (w * p)[some], 6))):
                yield ("after", str(e), str(d)), x, y


def _merged(start: Model, sums: list, no: int) -> Model:
    """The model of a round from the sums of all blocks."""
    new = Model()
    for name in ("left_class", "left", "right_class", "right"):
        getattr(new, name).update({k: list(v) for k, v in getattr(start, name).items()})
    seen = {k: [5.0, 20.0] for k in new.after}
    for (kind, *k), without, with_ in sums:
        q, p = without / ONE, with_ / ONE
        if kind == "left":
            new.see(0, q, k[1], k[0], None, None)
        elif kind == "right":
            new.see(0, q, "", "none", k[1], k[0])
        elif kind == "pair":
            new.class_pair[k[0], k[2]] += q
            if k[1] is not None:
                new.pair[k[1], k[2]] += q
        elif kind == "mark":
            own = new.marks.setdefault(k[0], list(start.marks.get(k[0].rstrip("~"), UNKNOWN_MARK)))
            own[0] += q
            own[1] += p
            new.prior[0] += q
            new.prior[1] += p
        elif kind == "thai":
            new.thai[k[0], k[1]][0] += q
            new.thai[k[0], k[1]][1] += p
        else:
            seen[int(k[0]), int(k[1])][0] += q
            seen[int(k[0]), int(k[1])][1] += p
    return _settled(new, start, seen if no else None)


def _distinct_records(df: DataFrame) -> DataFrame:
    """(id, text) with each id once; only texts of repeated ids are shuffled."""
    records = df.where("id is not null and text is not null").select(F.col("id").cast("string").alias("id"), "text")
    again = checkpointed(records.groupBy("id").count().where("count > 1").select("id"))
    keys = F.broadcast(again) if again.count() <= BROADCAST_KEYS else again
    return records.join(keys, "id", "left_anti").union(records.join(keys, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")))


_SUMS = "kind string, x string, y string, z string, without bigint, event bigint"


def _sum_batches(sums: dict[tuple, list[int]]) -> Iterator[pa.RecordBatch]:
    rows = [(*(*k, None, None)[:4], *v) for k, v in sums.items()]
    for s in range(0, len(rows), 50_000):
        cols = list(zip(*rows[s : s + 50_000]))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols[:4]] + [pa.array(c, pa.int64()) for c in cols[4:]], names=["kind", "x", "y", "z", "without", "event"])


def _collected(rows: DataFrame) -> list[tuple[tuple, int, int]]:
    got = rows.groupBy("kind", "x", "y", "z").agg(F.sum("without").alias("without"), F.sum("event").alias("event")).collect()
    return sorted([((r[0], r[1], r[2], r[3]), r[4], r[5]) for r in got], key=lambda r: tuple(x or "" for x in r[0]))


def counted_model(df: DataFrame):
    """Broadcast of the model of (id, text), counted over all records.

    Gaps are found once and kept as numbers in blocks; each round is one pass over the blocks, which gives sums by word. Sums are whole
    numbers, and of the gaps with the same two words the one that is least by id and place, both hashed, counts, so the order of
    records and their partitions don't matter. The driver and each worker hold the vocabulary, never texts or gaps.
    """
    sc = df.sparkSession.sparkContext

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        no, block = TaskContext.get().partitionId() << 16, Block()

        def row() -> pa.RecordBatch:
            places = [(xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) - (1 << 63), o - (1 << 63), (no << 31) + k) for w, (o, k) in block.words.items()]
            words = [np.array(c, dtype=np.int64) for c in zip(*places)] or [np.zeros(0, dtype=np.int64)] * 3
            closings = [{"kind": k[0], "x": k[1], "y": k[2], "n": n} for k, n in block.closings.items()]
            arrays = [pa.array([no]), pa.array([block.pack()], pa.binary()), *(pa.array([w], pa.list_(pa.int64())) for w in words)]
            closing_type = pa.list_(pa.struct([("kind", pa.string()), ("x", pa.string()), ("y", pa.string()), ("n", pa.int64())]))
            return pa.RecordBatch.from_arrays([*arrays, pa.array([closings], closing_type)], names=["no", "data", "hashes", "orders", "places", "closings"])

        for batch in batches:
            for part, texts in text_batches(iter([batch])):
                for key, text in zip(part.column(0).to_pylist(), texts):
                    block.add(key, text)
                    if len(block.ids) > BLOCK_GAPS:
                        yield row()
                        no, block = no + 1, Block()
        yield row()

    schema = "no bigint, data binary, hashes array<bigint>, orders array<bigint>, places array<bigint>, closings array<struct<kind: string, x: string, y: string, n: bigint>>"
    found = checkpointed(_distinct_records(df).mapInArrow(blocks, schema))
    start = Model()
    for r in found.select(F.explode("closings").alias("c")).groupBy("c.kind", "c.x", "c.y").agg(F.sum("c.n")).collect():
        if r[0] == "left":
            start.see(1, float(r[3]), r[2], r[1], None, None)
        else:
            start.see(1, float(r[3]), "", "none", r[2], r[1])
    words = found.select(F.explode(F.arrays_zip("hashes", "orders", "places")).alias("w")).groupBy("w.hashes").agg(F.min_by("w.places", "w.orders").alias("place"))
    first = words.select(F.expr("place >> 31").alias("no"), F.expr("cast(place & 2147483647 as int)").alias("at")).groupBy("no").agg(F.collect_list("at").alias("first"))
    packed = checkpointed(found.select("no", "data").join(first, "no", "left"))
    model = start
    for no in range(ROUNDS):
        sent = sc.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, no=no) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple, list[int]] = {}
            for batch in batches:
                for data, own in zip(batch.column(0).to_pylist(), batch.column(1)):
                    for k, x, y in _expected(data, own.values.to_numpy() if own.is_valid else [], sent.value, no):
                        s = sums.setdefault(k, [0, 0])
                        s[0] += x
                        s[1] += y
            yield from _sum_batches(sums)

        model = _merged(start, _collected(packed.select("data", "first").mapInArrow(run, _SUMS)), no)
        sent.unpersist()
    return sc.broadcast(model)


def sentence_units(df: DataFrame) -> DataFrame:
    """(rec_id, start_char, end_char) of the units of (id, text).

    Units of a record travel as two arrays; repeated records are made one over these, never over texts.
    """
    records = df.where("id is not null and text is not null").select("id", "text")
    model = counted_model(records)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ints = pa.list_(pa.int32())
        m = model.value
        for batch in batches:
            for part, texts in text_batches(iter([batch])):
                found = [units(t, m) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([x for x, _ in found], ints), pa.array([y for _, y in found], ints)], names=["id", "starts", "ends"]
                )

    cut = records.mapInArrow(run, "id string, starts array<int>, ends array<int>")
    once = cut.groupBy("id").agg(F.first(F.struct("starts", "ends")).alias("u"))
    return once.select(F.col("id").alias("rec_id"), F.explode(F.arrays_zip("u.starts", "u.ends")).alias("x")).select(
        "rec_id", F.col("x.starts").alias("start_char"), F.col("x.ends").alias("end_char")
    )
