"""Held-out passages in documents: one Aho-Corasick automaton over normalised test texts, scanned once per text."""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LeakRules:
    least_words: int = 24
    words_per_edit: int = 10
    anchor_words: int = 5


#: Markup that shows no text. Group `gap` separates words, all else joins what stands beside it.
MARKUP = re.compile(
    r"""(?P<gap><!--|-->|</?(?:br|p|div|li|ul|ol|tr|td|th|table|blockquote|h\d|hr|poem)\b[^<>]*>|\{\{|\}\}|\[\[(?:[Ff]ile|[Ii]mage|[Cc]ategory|[Kk]ategorie|[Cc]atégorie|[Cc]ategoría):)
    |</?[a-zA-Z][^<>]*>
    |\[\[(?:[^\[\]|\n]*\|)?|\]\]
    |\[(?:https?:)?//[^\s\]]*
    |'{2,}
    |(?P<entity>&(?:\#\d{1,7}|\#[xX][0-9a-fA-F]{1,6}|[a-zA-Z]{2,12});)
    |[­​-‏⁠﻿̀-ͯ]+""",
    re.X | re.S,
)
#: Stands between the text and what is taken out of it; more words than a place may have edits, so that none bridge it.
WALL = " ꙮ" * 6 + " "
#: A text without any of these has no markup.
SIGNS = re.compile("[<{\\[&­​-‏⁠﻿̀-ͯ]|''|\\]\\]")
#: What footnotes and templates begin, end and are divided by.
NESTED = re.compile(r"<ref\b[^<>]*?/>|<ref\b[^<>]*>|</ref\s*>|\{\{|\}\}|\[\[|\]\]|\|")
#: Templates that note something about the text around them, and names under which templates hold shown text; fixed values.
NOTES = frozenset(["sfn", "efn", "refn", "ref", "r", "note", "harvnb", "harv", "cn", "fact", "citation needed", "clarify", "when", "who", "which", "by whom", "dubious", "dead link", "page needed", "better source needed", "verify source", "update after", "as of"])
SHOWN = frozenset(["1", "2", "3", "text", "quote", "content"])
NAMED = re.compile(r"\s*([^\s={}\[\]<>|][^={}\[\]<>|]*?)\s*=")

Range = tuple[int, int]


@dataclass
class _Element:
    """A footnote or template: what of it is shown in place, and what is read apart."""

    start: int
    end: int
    keep: Range
    apart: list[Range]
    joins: bool


def _template(text: str, start: int, end: int, bars: list[int]) -> _Element:
    """Of a template, its longest argument without a name is shown in place; the others are read apart."""
    cuts = [*bars, end - 2]
    args = [(a + 1, b) for a, b in zip(cuts, cuts[1:], strict=False)]
    shown: list[Range] = []
    for a, b in args:
        m = NAMED.match(text, a, b)
        if not m:
            shown.append((a, b))
        elif m[1].lower() in SHOWN:
            shown.append((m.end(), b))
    name = text[start + 2 : cuts[0]].strip().lower()
    keep = (end, end) if name in NOTES or not shown else max(shown, key=lambda r: r[1] - r[0])
    return _Element(start, end, keep, [(a, b) for a, b in args if b != keep[1]], False)


def _elements(text: str) -> list[_Element]:
    """Closed footnotes and templates, in order of their start."""
    stack: list[tuple[str, int, list[int]]] = []
    count = {"<": 0, "{": 0, "[": 0}
    out = []
    for m in NESTED.finditer(text):
        t = m[0]
        if t == "|":
            if stack and stack[-1][0] == "{":
                stack[-1][2].append(m.start())
        elif t.endswith("/>") and t[1] != "/":
            out.append(_Element(m.start(), m.end(), (m.end(), m.end()), [], True))
        elif t in ("{{", "[[") or t[:2] == "<r":
            stack.append((t[0], m.start() if t[0] != "<" else m.end(), []))
            count[t[0]] += 1
            if t[0] == "<":
                stack[-1][2].append(m.start())
        else:
            kind = {"}": "{", "]": "[", "<": "<"}[t[0]]
            if not count[kind] or kind == "[" and stack[-1][0] != "[":
                continue
            while True:
                k, at, marks = stack.pop()
                count[k] -= 1
                if k == kind:
                    break
            if kind == "<":
                out.append(_Element(marks[0], m.end(), (m.end(), m.end()), [(at, m.start())], True))
            elif kind == "{":
                out.append(_template(text, at, m.end(), marks))
    out.sort(key=lambda e: e.start)
    return out


def _flow(elements: list[_Element], starts: list[int], ranges: list[Range]) -> Iterator[tuple[int, int, bool, _Element | None]]:
    """(from, to, joins, element) of what is shown of ranges, in order; an element that ends or begins there is handed out once."""
    for a, b in ranges:
        at, i, open_ends = a, bisect_left(starts, a), []
        while True:
            begin = elements[i].start if i < len(elements) and elements[i].start < b else None
            if open_ends and (begin is None or open_ends[-1][0] <= begin):
                stop, after, joins = open_ends.pop()
                yield at, stop, joins, None
                at, i = after, max(i, bisect_left(starts, after))
            elif begin is not None:
                e = elements[i]
                yield at, begin, e.joins, e
                at = e.keep[0] if e.keep[0] < e.keep[1] else e.end
                i = max(i + 1, bisect_left(starts, at))
                if e.keep[0] < e.keep[1]:
                    open_ends.append((e.keep[1], e.end, e.joins))
            else:
                yield at, b, False, None
                break


class _Plain(dict):
    """For str.translate, one character for each: letters and digits in lower case without accents, else a blank."""

    def __missing__(self, code: int) -> str:
        base = unicodedata.normalize("NFKD", chr(code))[:1].lower()[:1]
        self[code] = base if base.isalnum() else " "
        return self[code]


PLAIN = _Plain()


def normalised(text: str) -> tuple[str, list[tuple[int, int]]]:
    """The text in lower case without markup, accents and punctuation, and the offset map.

    Footnotes, and of templates all but the longest argument without a name, are left out where they stand and follow the
    text, each behind a wall of words that no text has: nothing is dropped.
    The map has (place in the result, place in the original) where they begin to differ by another distance.
    """
    if not SIGNS.search(text):
        return text.translate(PLAIN), [(0, 0)]
    elements = _elements(text)
    starts = [e.start for e in elements]
    parts, out, shifts = [], 0, [(0, 0)]
    ahead: list[list[Range]] = [[(0, len(text))]]

    def put(piece: str) -> None:
        nonlocal out
        if piece:
            parts.append(piece)
            out += len(piece)

    for ranges in ahead:  # grows while it is read
        if out:
            put(WALL)
        for a, b, joins, element in _flow(elements, starts, ranges):
            shifts.append((out, a))
            at = a
            for m in MARKUP.finditer(text, a, b):
                put(text[at : m.start()])
                if m.lastgroup == "gap":
                    put(" ")
                elif m.lastgroup == "entity":
                    shown = html.unescape(m[0])[:1]
                    put("" if shown in "­​‌‍‎‏" or shown == "&" and len(m[0]) != 5 else shown)
                at = m.end()
                shifts.append((out, at))
            put(text[at:b])
            if not joins:
                put(" ")
            if element and any(WORDED.search(text, *r) for r in element.apart):
                ahead.append(element.apart)
    return "".join(parts).translate(PLAIN), shifts


WORDED = re.compile(r"\w")


def original_place(shifts: list[tuple[int, int]], place: int) -> int:
    """Where in the original a place of the normalised text is."""
    lo, hi = 0, len(shifts)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if shifts[mid][0] <= place else (lo, mid)
    return shifts[lo][1] + place - shifts[lo][0]


class LeakFinder:
    """The automaton over all runs of `anchor_words` words of the test texts; made once in each Python worker."""

    def __init__(self, items: tuple[tuple[int, str, str], ...], rules: LeakRules):
        self.rules = rules
        # edits cut a place in runs of words; what they leave has at least so many anchors
        runs = lambda words: words // rules.words_per_edit
        self.least = min(w - runs(w) - (rules.anchor_words - 1) * (runs(w) + 1) for w in range(rules.least_words, 2 * rules.least_words))
        self.texts: dict[tuple[str, ...], list[tuple[int, str]]] = defaultdict(list)
        for item, field, text in items:
            words = tuple(normalised(text or "")[0].split())
            if words:
                self.texts[words].append((item, field))
        self.words = list(self.texts)
        anchors: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, words in enumerate(self.words):
            n = min(rules.anchor_words, len(words))
            for i in range(len(words) - n + 1):
                anchors[" " + " ".join(words[i : i + n]) + " "].append((k, i))
        self.automaton = ahocorasick.Automaton()
        for anchor, places in anchors.items():
            self.automaton.add_word(anchor, places)
        if anchors:
            self.automaton.make_automaton()

    def find(self, text: str) -> Iterator[tuple[int, str, int, int, int, int, int]]:
        """(item, field, start, end, words, edits, of) for each test text that stands in the text; places in the original."""
        if not self.words or not text:
            return
        plain, shifts = normalised(text)
        words = plain.split()
        flat = " " + " ".join(words) + " "
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for end, places in self.automaton.iter(flat):
            for k, i in places:
                hits[k].append((end, i))
        if not hits:
            return
        starts, seen, short = None, set(), []
        for k, found in hits.items():
            target = self.words[k]
            whole = len(target) < self.rules.least_words  # short texts, as answers, count whole only
            anchor = min(self.rules.anchor_words, len(target))
            least = len(target) - anchor + 1 if whole else self.least
            if len({i for _, i in found}) < max(1, least):
                continue
            if starts is None:
                starts = [m.span() for m in re.finditer(r"\S+", plain)]
                word_at = np.cumsum(np.frombuffer(flat.encode("utf-32-le"), np.uint32) == 32)
            # the number of the anchor's first word is that of blanks before it
            spots = [(int(word_at[end]) - 1 - anchor, i) for end, i in found]
            best = _aligned(words, target, spots, self.rules, whole, anchor)
            if best:
                a, b, n, edits = best
                begin, stop = original_place(shifts, starts[a][0]), original_place(shifts, starts[b - 1][1] - 1) + 1
                for item, field in self.texts[target]:
                    hit = item, field, begin, stop, n, edits, len(target)
                    if len(target) < self.rules.anchor_words:
                        short.append(hit)
                    else:
                        seen.add(item)
                        yield hit
        yield from (hit for hit in short if hit[0] in seen)


def _aligned(words: list[str], target: tuple[str, ...], spots: list[tuple[int, int]], rules: LeakRules, whole: bool, anchor: int) -> tuple[int, int, int, int] | None:
    """(first word, end, words of the target, edits) of a place with enough successive words and few enough edits, or None."""
    runs: dict[int, list[int]] = defaultdict(list)
    for t, i in spots:
        runs[t - i].append(i)
    longest = (0, 0, 0)
    for shift, at in runs.items():
        at = sorted(set(at))
        begin = at[0]
        for p, i in enumerate(at):
            if p and i != at[p - 1] + 1:
                begin = i
            longest = max(longest, (i - begin + anchor, begin, shift))
    n, i, shift = longest
    if n >= (len(target) if whole else rules.least_words):
        return i + shift, i + shift + n, n, 0
    if whole:
        return None
    lo, hi = max(0, min(t for t, _ in spots) - len(target)), min(len(words), max(t for t, _ in spots) + len(target) + anchor)
    code = {w: c for c, w in enumerate(dict.fromkeys(target))}
    text = np.array([code.get(w, -1) for w in words[lo:hi]])
    # A longer place with so few edits holds one of less than twice least_words, so no more edits need be followed.
    most = (2 * rules.least_words - 1) // rules.words_per_edit
    width = len(text) + 1
    none = -(10**6)
    # got[e]: most target words of a place that ends here with e edits; frm[e]: where it began in the text
    got = np.full((most + 1, width), none)
    got[0] = 0
    frm = np.tile(np.arange(width), (most + 1, 1))
    for p in range(len(target)):
        same = np.r_[False, text == code[target[p]]]
        now, at = np.full_like(got, none), frm.copy()
        now[0], at[0] = 0, np.arange(width)
        for e in range(most + 1):
            options = [(np.r_[none, got[e, :-1]] + 1, np.r_[0, frm[e, :-1]], same)]
            if e:
                options += [(np.r_[none, got[e - 1, :-1]] + 1, np.r_[0, frm[e - 1, :-1]], True), (got[e - 1] + 1, frm[e - 1], True), (np.r_[none, now[e - 1, :-1]], np.r_[0, at[e - 1, :-1]], True)]
            for value, begin, ok in options:
                better = (value > now[e]) & ok
                now[e] = np.where(better, value, now[e])
                at[e] = np.where(better, begin, at[e])
            if e:
                now[e] = np.where(now[e] > e, now[e], none)  # a place begins with a match
            done = np.flatnonzero((now[e] >= rules.least_words) & (now[e] >= e * rules.words_per_edit))
            if len(done):
                t = int(done[0])
                return lo + int(at[e, t]), lo + t, int(now[e, t]), e
        got, frm = now, at
    return None


@lru_cache(maxsize=2)
def _finder(items: tuple[tuple[int, str, str], ...], rules: LeakRules) -> LeakFinder:
    return LeakFinder(items, rules)


def leaks(documents: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", fields: tuple[str, ...] = ("passage", "question", "answer"), rules: LeakRules = LeakRules(), most_item_bytes: int = 64_000_000) -> DataFrame:
    """(doc_id, item_id, field, start_pos, end_pos, words, edits, of_words): test texts that stand in documents.

    A test text of at least `least_words` words is found where that many successive words of it stand in order with at
    most one edit (a word changed, dropped or added) in `words_per_edit`; a shorter one, as most answers are, only whole
    and exact. One automaton holds every run of `anchor_words` words of all test texts; each document is normalised and
    scanned once, markup aside (of a template its longest argument without a name stands in place, its others and
    footnotes are read after the text), and word alignment tests what has anchors enough. A text of less than `anchor_words` words, which stands
    in many documents by chance, counts only beside another text of its item. Places are 0-based in the original text, the first
    place found for each item and field.

    The test texts go to every worker; they are refused beyond `most_item_bytes`. The corpus isn't shuffled at all.

    Defined cases: null or empty texts have no leaks, null test texts are none; of items with the same text each is
    reported; repeated documents are each reported; an empty corpus or no items give no rows; other columns aren't read.
    """
    shown = items.select(F.col(f"`{item_id}`").alias("item"), *[F.col(f"`{f}`").cast("string").alias(f"f{k}") for k, f in enumerate(fields)]).where("item is not null")
    size = shown.agg(sum((F.coalesce(F.sum(F.octet_length(f"f{k}")), F.lit(0)) for k in range(len(fields))), F.lit(0)).alias("bytes")).first()["bytes"]
    if size > most_item_bytes:
        raise ValueError(f"the test texts have {size} bytes; the bound is {most_item_bytes}")
    held = tuple(sorted({(r["item"], f, r[f"f{k}"]) for r in shown.collect() for k, f in enumerate(fields) if r[f"f{k}"]}))
    sent = documents.sparkSession.sparkContext.broadcast(held)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(sent.value, rules)
        for batch in batches:
            found = [(d, *hit) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t for hit in finder.find(t)]
            if found:
                yield pa.record_batch(dict(zip(("doc_id", "item_id", "field", "start_pos", "end_pos", "words", "edits", "of_words"), map(list, zip(*found, strict=True)), strict=True)))

    docs = documents.select(F.col(f"`{doc_id}`").cast("bigint"), F.col(f"`{text}`").cast("string"))
    return docs.mapInArrow(scan, "doc_id long, item_id long, field string, start_pos long, end_pos long, words long, edits long, of_words long")
