"""Sentence boundaries across languages and scripts.

A pushdown automaton runs over each text. Its first level classifies lines (heading,
list item, log or query line: one unit each; blank lines end a unit) and keeps a stack of
list levels, by which an indented line goes on the item it stands under; over the rest it
keeps a stack of open quotations and brackets and emits a boundary at a terminator only
with an empty stack. Terminators are those of all scripts in Unicode. Abbreviations are
held in a trie read backwards from the full stop; further ones may be given.

Defined results: null, empty and blank texts give no units; texts of any length are read
whole; an unclosed quotation or bracket counts as plain text; equal texts under several
doc_id give equal units; lang isn't read, so a wrong one does no harm; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Abbreviations that never end a sentence, that end one only before a capital, and that don't before a digit (fixed values).
NEVER = (
    "e.g i.e vs cf approx aprox esp insb bzw ca env ver p.ex p.ej z.b d.h u.a т.е т.к см напр viz al mr mrs ms. dr prof st hr fr sr sra ggf evtl vgl inkl zzgl "
    "z d p т gov sen capt sgt hon messrs mme mlle"
).split()
MAY = "etc usw p.m a.m u.s u.k inc ltd corp co т.д т.п г гг ч мин сек bros jr".split()
BEFORE_DIGIT = (
    "no nr núm num rs n fig figs sec sect abs art pág pag pp p abb tab kap bd vol ch chap eq ref рис стр табл гл п "
    "jan feb mar apr jun jul aug sep sept oct nov dec"
).split()
_GERMAN_MONTHS = "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split()

_OPEN = {"(": ")", "[": "]", "{": "}", "（": "）", "【": "】", "「": "」", "『": "』", "《": "》", "〈": "〉", "«": "»", "“": "”", "„": "“", "‹": "›", "»": "«"}
_QUOTES = set("\"«“„‹「『»")
#: Terminators that may also stand inside a sentence, or be followed by more of it.
_OPEN_ENDS = ".!?…‼⁇⁈⁉"


def _sentence_terminals() -> str:
    """The characters that end sentences in any script, but for those above."""
    import regex

    planes = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x20000))))
    return "".join(c for c in regex.findall(r"\p{Sentence_Terminal}", planes) if c not in _OPEN_ENDS)


_FULL_ENDS = frozenset(_sentence_terminals())
_ENDS = _FULL_ENDS | set(_OPEN_ENDS)
_AFTER = _ENDS | set(")）”\"»」")
_CJK = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\uac00-\ud7af"
_PARTICLES = set("とのがはをにでも的")
_THAI = "\u0e01-\u0e3a\u0e40-\u0e4e"
_EVENT = re.compile(rf"[{re.escape(''.join(sorted(_ENDS)))}]+|[\"()\[\]{{}}（）【】「」『』《》〈〉«»“”„‹›]|(?<=[{_THAI}])\s+(?=[{_THAI}])")
_CJK_CHAR = re.compile(f"[{_CJK}]")
_SPECIAL = re.compile(
    r"[ \t]*(?:"
    r"(?P<heading>#{1,6}(?:\s|$))"
    r"|(?P<bullet>[-*+•‣◦–—·・](?=\s))"
    r"|(?P<number>(?:\(?\d{1,3}[.)]|\(?[a-zA-Z]\)|[ivxIVX]{1,5}[.)]|[①-⑳])(?=\s))"
    r"|(?P<log>(?:<\d{1,3}>(?:\d )?)?\[?(?:\d{4}[-/]\d\d[-/]\d\d[T ]\d\d:\d\d|[A-Z][a-z]{2} [ \d]\d \d\d:\d\d:\d\d|ts=\S+ |\d{1,2}/[A-Z][a-z]{2}/\d{4}:)|\{\"|[IWEF]\d{4} \d\d:\d\d|(?:\d{1,3}\.){3}\d{1,3} \S+ \S+ \[)"
    r"|(?P<query>\||from\s+[\w*$,-]+(?:\[[^\]\n]*\])?\s*(?:\||$)|let\s+\$\w+\s*=|//|/\*)"
    r")"
)
_MONTHS_AHEAD = re.compile(r"\s+(?:" + "|".join(_GERMAN_MONTHS) + r")\b")


def _trie(words: list[str], kind: str, root: dict) -> None:
    for w in words:
        node = root
        for c in reversed(w):
            node = node.setdefault(c, {})
        node[None] = kind


def trie_of(further: tuple[str, ...] = ()) -> dict:
    """The abbreviations, read backwards, with further ones that never end a sentence."""
    root: dict = {}
    for words, kind in ((BEFORE_DIGIT, "digit"), (MAY, "may"), (NEVER, "never"), ([w.lower() for w in further], "never")):
        _trie(words, kind, root)
    return root


_ABBREVIATIONS = trie_of()


def _abbreviation(text: str, at: int, low: int, known: dict) -> str | None:
    """The kind of the longest abbreviation that ends before the full stop at at, in text[low:]."""
    node, found, i = known, None, at - 1
    while i >= low:
        c = text[i].lower()
        if c.isspace():  # z. B., p. ex.
            if i - 1 < low or text[i - 1] != ".":
                break
            i -= 1
            continue
        node = node.get(c)
        if node is None:
            break
        if None in node and (i == low or not (text[i - 1].isalnum() or text[i - 1] in "-_/")):
            found = node[None]
        i -= 1
    return found


def _pairs(text: str, low: int, high: int) -> dict[int, int]:
    """Position of the closer for each opener (and back, negative) that has one in text[low:high]."""
    out: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    for i in range(low, high):
        c = text[i]
        if c == '"':
            if any(s[0] == '"' for s in stack):
                while stack[-1][0] != '"':
                    stack.pop()
                out[stack.pop()[1]] = i
            else:
                stack.append(('"', i))
            continue
        if c in "”“»«)]}）】」』》〉›":
            want = [k for k, s in enumerate(stack) if s[0] == c]
            if want:
                out[stack[want[-1]][1]] = i
                del stack[want[-1] :]
                continue
        if c in _OPEN:
            stack.append((_OPEN[c], i))
    return out


class _Words:
    """Where the word before a place begins, in one pass over the text however long its words are."""

    def __init__(self, text: str, low: int):
        self.text, self.seen, self.first = text, low, low
        self.of, self.letter, self.dot = -1, 0, 0

    def before(self, i: int, start: int) -> tuple[int, bool]:
        """(its first character, whether a dot stands between characters of it other than digits and dots)."""
        text = self.text
        for k in range(i - 1, self.seen - 1, -1):
            if not (text[k].isalnum() or text[k] in "_.’'-"):
                self.first = k + 1
                break
        self.seen = max(self.seen, i)
        first = max(self.first, start)
        if self.of != first:
            self.of, self.letter = first, first
            self.dot = -1
        while self.letter < i and text[self.letter] in "0123456789.":
            self.letter += 1
            self.dot = -1
        if self.dot < self.letter:
            found = text.find(".", self.letter, i)
            self.dot = found if found >= 0 else -1
        last = i
        while last > self.letter and text[last - 1] in "0123456789.":
            last -= 1
        return first, self.letter <= self.dot < last


def _case(c: str) -> str:
    return "up" if c.isupper() else "low" if c.islower() else "digit" if c.isdigit() else "none"


def _block(text: str, low: int, high: int, known: dict) -> list[int]:
    """Ends of the units of a paragraph text[low:high], without the last."""
    ends: list[int] = []
    if not any(c in text[low:high] for c in '"([{（【「『《〈«“„‹'):
        pairs: dict[int, int] = {}
    else:
        pairs = _pairs(text, low, high)
    start, at = low, low
    match = _EVENT.search
    words = None
    while m := match(text, at, high):
        i, j, c = m.start(), m.end(), m[0][0]
        at = j
        if c.isspace():
            ends.append(i)
            start = j
            continue
        if c not in _ENDS:
            if i not in pairs:
                continue
            close = pairs[i]
            at = close + 1
            inside = text[i + 1 : close].rstrip()
            if not inside or inside[-1] not in _ENDS and inside[-1] not in ")）”’»」』":
                continue
            k = at
            while k < high and text[k].isspace():
                k += 1
            if k >= high or text[at] in _ENDS:
                continue
            begins = not text[start:i].strip()
            n, cjk = text[k], inside[-1] in "。！？｡．"
            quote = c in _QUOTES
            if cjk:
                split = n not in _PARTICLES and (begins or not quote or k > at)
            elif begins and not quote:
                split = True
            else:
                split = _case(n) == "up" or (n in _OPEN or n == '"') and (begins or k > at) or _case(n) == "digit" and begins
            if split:
                ends.append(at)
                start = at
            continue
        if j >= high:
            break
        n = text[j]
        space = n.isspace()
        k = j
        while k < high and text[k].isspace():
            k += 1
        if k >= high:
            break
        ahead = text[k]
        run = m[0]
        if run[-1] in _FULL_ENDS and "…" not in run:
            split = True
        elif run[0] == "…" or (run.startswith("..") and set(run) == {"."}):
            split = _case(ahead) == "up" or (ahead in _OPEN or ahead == '"') and space
        elif not space:
            token = re.match(r"\S*", text[j:high])[0]
            glued = bool(_CJK_CHAR.search(token))
            if run == ".":
                words = words or _Words(text, low)
                first, dotted = words.before(i, start)
                before = text[max(first, i - 1) : i]
                plain = before and (before.islower() or before.isdigit()) and not dotted and not text[first].isupper()
                glued_word = bool(re.match(r"[^\W\d_][\w’'-]*[,:;!?.]*(?:\s|$)", token + " ")) and n.isupper()
                opened = (n in _OPEN or n == '"') and j in pairs
                split = bool(plain and (glued_word or opened)) or (glued and not n.isdigit())
            else:
                split = glued or n.isupper() or (n in _OPEN or n == '"') and j in pairs
        elif run != ".":
            split = True
        else:
            kind = _abbreviation(text, i, start, known)
            if kind == "digit":
                kind = "never" if ahead.isdigit() or ahead in "°#" else None
            if kind == "never":
                split = False
            elif kind == "may":
                word = re.match(r"\w*", text[k:high])[0]
                split = (_case(ahead) == "up" and not (len(word) > 1 and word.isupper())) or ahead in _OPEN or ahead == '"' or (_case(ahead) == "none")
            elif text[i - 1 : i].isdigit() and _MONTHS_AHEAD.match(text, j) and re.search(r"(?<![\d.,])\d{1,2}$", text[max(start, i - 4) : i]):
                split = False
            elif text[i - 1 : i].isupper() and not text[i - 2 : i - 1].isalnum() and i - 1 > start:
                split = False  # an initial
            elif not text[start:i].strip():
                split = False
            else:
                split = True
        if split:
            ends.append(j)
            start = j
    return ends


def _goes_on(line: str, known: dict) -> bool:
    """Whether the sentence that ends a line goes on in the next one."""
    if line[-1] in ":：":
        return False
    if line[-1] == ".":
        return _abbreviation(line, len(line) - 1, 0, known) in ("never", "digit")
    return line[-1] not in _AFTER


def units(text: str | None, known: dict = _ABBREVIATIONS) -> list[tuple[int, int]]:
    """(start, end) of each sentence unit, in code points."""
    if not text or text.isspace():
        return []
    # (start, end); a start below 0 is one unit whatever it contains
    cuts: list[tuple[int, int]] = []
    at, block, last = 0, None, ""
    levels: list[int] = []  # indentation of the list items that are open, the innermost last
    n = len(text)
    while at <= n:
        end = text.find("\n", at)
        end = n if end < 0 else end
        line = text[at:end]
        bare = line.strip()
        m = _SPECIAL.match(line) if bare else None
        if m and block is not None and last and (m["bullet"] in ("–", "—") or m["number"] and _goes_on(last, known)):
            m = None  # a number or dash that a line break put first
        depth = len(line) - len(line.lstrip(" \t")) if bare else -1
        while levels and (depth < levels[-1] or depth == levels[-1] and not (m and (m["bullet"] or m["number"]))):
            levels.pop()
        if bare and not m and levels and depth > levels[-1]:
            cuts[-1] = (cuts[-1][0], end)  # the item goes on
            at = end + 1
            continue
        if not bare or m:
            if block is not None:
                cuts.append((block, at))
                block = None
            if m:
                cuts.append((-at - 1, end))
                if m["bullet"] or m["number"]:
                    if not levels or depth > levels[-1]:
                        levels.append(depth)
                else:
                    levels.clear()
            last = ""
        else:
            block = at if block is None else block
            last = bare
        at = end + 1
    if block is not None:
        cuts.append((block, n))
    out = []
    for low, high in cuts:
        if low < 0:
            pieces = [(-low - 1, high)]
        else:
            ends = _block(text, low, high, known)
            pieces = list(zip([low, *ends], [*ends, high]))
        for a, b in pieces:
            while a < b and text[a].isspace():
                a += 1
            while b > a and text[b - 1].isspace():
                b -= 1
            if a < b:
                out.append((a, b))
    return out


def sentence_units(documents: DataFrame, abbreviations: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, start_char, end_char of every unit of every document. abbreviations: further ones that never end a sentence, without their last full stop."""

    def run(batches):
        import pyarrow as pa

        known = trie_of(abbreviations)
        for b in batches:
            ids, starts, ends = [], [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for a, z in units(text, known):
                    ids.append(doc)
                    starts.append(a)
                    ends.append(z)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, starts, ends)], names=["doc_id", "start_char", "end_char"])

    # texts are long: batches of few rows bound a worker's memory
    return documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, start_char bigint, end_char bigint")
