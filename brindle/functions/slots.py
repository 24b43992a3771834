"""Tokens of a log line, and what the slots of a mined template mean. Plain Python, one line at a time.

A slot is typed by the values it holds: timestamp, level, number, identifier. The head of
an entry is then read along the template's slots: keys and marks are its constant slots,
timestamp, level and component its variable ones.
"""

from __future__ import annotations

import re
from typing import NamedTuple

#: Levels and how they are spelled (fixed values).
LEVELS = {
    "TRACE": "trace trc finest verbose",
    "DEBUG": "debug dbg debug1 debug2 debug3 debug4 debug5 fine",
    "INFO": "info inf information notice log",
    "WARN": "warn warning wrn",
    "ERROR": "error err eror severe",
    "FATAL": "fatal crit critical alert emerg emergency panic ftl",
}
SPELLED = {w: k for k, v in LEVELS.items() for w in v.split()}
LETTERS = {"T": "TRACE", "V": "TRACE", "D": "DEBUG", "I": "INFO", "W": "WARN", "E": "ERROR", "F": "FATAL", "C": "FATAL"}
#: Levels of syslog severities 0 to 7 (fixed values).
SEVERITY = ("FATAL", "FATAL", "FATAL", "ERROR", "WARN", "INFO", "INFO", "DEBUG")
TIME_KEYS = ("timestamp", "ts", "@timestamp", "time", "_time", "date")
LEVEL_KEYS = ("level", "lvl", "severity", "loglevel", "log_level")
COMPONENT_KEYS = ("component", "comp", "logger", "service", "module", "program", "app")
MESSAGE_KEYS = ("msg", "message")

GAP = "<*>"
NUMBER, ID = "<num>", "<id>"
#: Tokens after a timestamp whose slots are typed: a head is never longer.
HEAD_TOKENS = 32
#: Share of a slot's values that must be timestamps or have digits, and share that must be levels (few words are spelled like one by chance).
MOST, SOME = 0.5, 0.2

_TOKEN = re.compile(r"\d+|[A-Z](?=\d)|[^\W\d]\w*|\s+|.", re.S)
_MONTH = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]{0,6}\.?"
_M, _D, _Y = r"(?:1[0-2]|0?[1-9])", r"(?:3[01]|[12]\d|0?[1-9])", r"(?:19|20)\d\d"
_CLOCK = r"(?:[01]?\d|2[0-3]):[0-5]\d(?::[0-6]\d(?:[.,]\d{1,12})?)?(?: ?[AP]M\b)?"
_WORDS = "|".join(w for k in SPELLED for w in (k.upper(),) if len(w) <= 5)
#: What the value of a timestamp slot looks like: a date and a clock in any usual order, or Unix time.
STAMP_VALUE = re.compile(
    rf"(?:[A-Z][a-z]{{2,8}},? +)?(?:"
    rf"{_Y}(?P<s>[-/.]){_M}(?P=s){_D}(?:[Tt]| +|:){_CLOCK}"
    rf"|{_D}(?P<u>[-/. ])(?:{_M}|{_MONTH})(?P=u){_Y}(?:[Tt:]|,? +){_CLOCK}"
    rf"|{_M}/{_D}/{_Y}(?:,? +){_CLOCK}"
    rf"|{_MONTH} +{_D},?(?: +{_Y},?)? +{_CLOCK}(?: {_Y}\b)?"
    rf"|{_Y}(?:1[0-2]|0[1-9])(?:3[01]|[12]\d|0[1-9])[Tt ]?(?:[01]\d|2[0-3])[0-5]\d[0-5]\d(?:[.,]\d{{1,12}})?"
    rf")(?:\s?(?:Z|[+-]\d{{2}}:?\d{{2}})(?![\w:])| (?!(?:{_WORDS})\b)[A-Z]{{3,4}}(?=[\]) ]|$))?"
)
_LETTERED = re.compile(rf"(?:1[0-2]|0[1-9])(?:3[01]|[12]\d|0[1-9]) {_CLOCK}")
_EPOCH = re.compile(r"(?:\d{10}(?:[.,]\d{1,9})?|\d{13}|\d{16}|\d{19})(?![\w.])")


class Line(NamedTuple):
    text: str
    tokens: list[str]  # without white space
    symbols: list[str]  # of each token; a leading blank stands for white space before it
    at: list[int]  # where each token begins


def tokenised(text: str) -> Line:
    tokens, symbols, at = [], [], []
    blank = ""
    i = 0
    for t in _TOKEN.findall(text):
        if t.isspace():
            blank = " "
        else:
            if t.isalpha():
                s = t
            elif t.isdigit():
                s = NUMBER
            elif len(t) > 1 and any(map(str.isdigit, t)):
                s = ID
            else:
                s = t
            tokens.append(t)
            symbols.append(blank + s)
            at.append(i)
            blank = ""
        i += len(t)
    return Line(text, tokens, symbols, at)


def _end(x: Line, i: int) -> int:
    """Offset behind token i."""
    return x.at[i] + len(x.tokens[i])


def _token_at(x: Line, offset: int, low: int) -> int:
    """The first token from low that begins at or behind offset."""
    while low < len(x.at) and x.at[low] < offset:
        low += 1
    return low


def _keyed(x: Line) -> dict[str, tuple[int, int]] | None:
    """Tokens of the value of each key at the top of a JSON object or of key=value pairs; None for other lines."""
    t, n = x.tokens, len(x.tokens)
    out: dict[str, tuple[int, int]] = {}
    if n > 1 and t[0] == "{" and x.at[0] == 0:
        depth, i, key = 0, 0, None
        while i < n:
            c = t[i]
            if c == '"':
                j = i + 1
                while j < n and t[j] != '"':
                    j += 2 if t[j] == "\\" and j + 1 < n and x.at[j + 1] == x.at[j] + 1 and len(t[j + 1]) == 1 else 1
                if depth == 1 and j + 1 < n and t[j + 1] == ":":
                    key, i = x.text[x.at[i] + 1 : x.at[j]], j + 2
                    continue
                if depth == 1 and key is not None:
                    out.setdefault(key, (i + 1, j))
                    key = None
                i = j + 1
                continue
            if c in "{[":
                depth += 1
                key = None if depth > 1 else key
            elif c in "}]":
                depth -= 1
            elif c == ",":
                key = None
            elif depth == 1 and key is not None:
                j = i
                while j < n and t[j] not in ",}":
                    j += 1
                out.setdefault(key, (i, j))
                key, i = None, j
                continue
            i += 1
        return out
    i = 0
    while i < n and (i == 0 or x.symbols[i][0] != " ") and (t[i][0].isalnum() or t[i][0] in "_.@-"):
        i += 1
    if not 0 < i < n or t[i] != "=" or x.symbols[i][0] == " " or x.at[0]:
        return None
    i = 0
    while i < n:
        j = i
        while j < n and t[j] != "=" and (j == i or x.symbols[j][0] != " "):
            j += 1
        if j >= n or t[j] != "=" or x.symbols[j][0] == " ":
            i = max(j, i + 1)
            continue
        key = x.text[x.at[i] : x.at[j]]
        if j + 1 < n and t[j + 1] == '"' and x.symbols[j + 1][0] != " ":
            k = j + 2
            while k < n and t[k] != '"':
                k += 2 if t[k] == "\\" else 1
            out.setdefault(key, (j + 2, min(k, n)))
            i = k + 1
        else:
            k = j + 1
            while k < n and x.symbols[k][0] != " ":
                k += 1
            out.setdefault(key, (j + 1, k))
            i = k
    return out


class Stamp(NamedTuple):
    first: int  # tokens
    end: int
    pairs: dict | None


def stamp_of(x: Line) -> Stamp | None:
    """The tokens of the line's own timestamp: first thing in it but for marks, numbers, a level letter or a time key."""
    t, n = x.tokens, len(x.tokens)
    if n < 3 or x.at[0]:
        return None
    if t[0] == "{" or t[1] in "=.@-" and t[0][0].isalpha() or t[0] == "@":
        pairs = _keyed(x)
        if pairs is not None:
            for k in TIME_KEYS:
                if k in pairs and pairs[k][0] < pairs[k][1]:
                    a, b = pairs[k]
                    m = STAMP_VALUE.match(x.text, x.at[a]) or _EPOCH.match(x.text, x.at[a])
                    if m and m.end() >= _end(x, b - 1):
                        return Stamp(a, b, pairs)
            return None
    if t[0].isdigit() or t[0].isalpha():
        if m := STAMP_VALUE.match(x.text) or _EPOCH.match(x.text):
            return Stamp(0, _token_at(x, m.end(), 1), None)
        if t[0] in LETTERS and t[1].isdigit() and x.at[1] == 1 and (m := _LETTERED.match(x.text, 1)):
            return Stamp(1, _token_at(x, m.end(), 1), None)
    i = 0
    if t[0] == "<" and n > 3 and t[1].isdigit() and t[2] == ">":
        i = 4 if t[3].isdigit() and len(t[3]) <= 2 and n > 4 and x.symbols[4][0] == " " else 3
    while i < n and t[i] in '[("|':
        i += 1
    if 0 < i < n and (m := STAMP_VALUE.match(x.text, x.at[i]) or (_EPOCH.match(x.text, x.at[i]) if t[i - 1] in "[(" else None)):
        return Stamp(i, _token_at(x, m.end(), i), None)
    # three fields (client, identity, user), then a timestamp in brackets
    i = fields = 0
    while i < n and fields < 4 and t[i] != "[":
        i += 1
        fields += i < n and x.symbols[i][0] == " "
    if fields == 3 and i + 1 < n and t[i] == "[" and (m := STAMP_VALUE.match(x.text, x.at[i + 1])):
        return Stamp(i + 1, _token_at(x, m.end(), i + 1), None)
    return None


def level_of(text: str) -> str:
    return SPELLED.get(text.strip().lower(), "")


def aligned(template: list[str], symbols: list[str]) -> list[int] | None:
    """The slot of the template that each symbol falls into; None if the template doesn't fit."""
    out: list[int] = [0] * len(symbols)
    t = i = 0
    gap, back = -1, 0
    n, m = len(symbols), len(template)
    while i < n:
        if t < m and template[t] == GAP:
            gap, back, t = t, i, t + 1
        elif t < m and template[t] == symbols[i]:
            out[i] = t
            t, i = t + 1, i + 1
        elif gap >= 0:
            out[back] = gap
            back += 1
            t, i = gap + 1, back
        else:
            return None
    return out if all(x == GAP for x in template[t:]) else None


def form(symbol: str) -> str:
    """A symbol with every word as w."""
    bare = symbol[1:] if symbol[0] == " " else symbol
    return symbol if bare[0] == "<" and len(bare) > 1 or not bare[0].isalpha() and bare[0] != "_" else symbol[: -len(bare)] + "w"


def places(slots: list[int], symbols: list[str], low: int, high: int) -> list[str]:
    """The place of each token in low to high: its slot, its position there (behind low) and the forms beside it.

    A gap may hold heads of several forms; what stands beside a value keeps them apart.
    """
    out = []
    n, k = len(slots), 0
    for i in range(low, high):
        if i > low:
            k = k + 1 if slots[i] == slots[i - 1] else 0
        out.append(f"{slots[i]}+{k} {form(symbols[i - 1]) if i else ''} {form(symbols[i + 1]) if i + 1 < n else ''}")
    return out


def held(x: Line, i: int) -> str:
    """What the slot of token i holds: a word, number or identifier, or all that a bracket encloses; empty for other marks."""
    t = x.tokens[i]
    if t != "[":
        return t if t[0].isalnum() else ""
    j = i + 1
    while j < len(x.tokens) and x.tokens[j] != "]" and j - i < HEAD_TOKENS:
        j += 1
    return x.text[x.at[i] : x.at[j]] if j < len(x.tokens) else ""


class Roles(NamedTuple):
    begins: bool
    stamp: tuple[int, int]
    level: str
    priority: int  # token of a syslog priority, or -1
    component: tuple[int, int]
    message: tuple[int, int]  # end -1: to the end of the line
    json: bool


NOTHING = Roles(False, (0, 0), "", -1, (0, 0), (0, -1), False)


def roles(x: Line, found: Stamp, levels: list[bool], digits: list[bool]) -> Roles:
    """What the slots behind a timestamp are. levels and digits tell, for HEAD_TOKENS tokens from found.end, what their slots mostly hold."""
    t, n, s = x.tokens, len(x.tokens), x.symbols
    stamp = (found.first, found.end)
    if found.pairs is not None:
        pairs, json = found.pairs, t[0] == "{"
        one = lambda keys: next((pairs[k] for k in keys if k in pairs), None)
        a = one(LEVEL_KEYS)
        level = level_of(x.text[x.at[a[0]] : _end(x, a[1] - 1)]) if a and a[0] < a[1] else ""
        return Roles(True, stamp, level, -1, one(COMPONENT_KEYS) or (0, 0), one(MESSAGE_KEYS) or (0, 0), json)
    spaced = lambda i: i >= n or s[i][0] == " "
    base = found.end
    is_level = lambda i: i - base < len(levels) and i < n and levels[i - base] and bool(level_of(t[i]))
    has_digits = lambda i: i - base < len(digits) and digits[i - base]
    i = base
    while i < n and t[i] in '])"' and not spaced(i):
        i += 1
    priority = -1
    if t[0] == "<":
        priority = 1
        fields = []
        if found.first > 3 and t[3].isdigit():  # version: host, program, process, message id, data
            j = i
            while j < n and len(fields) < 4:
                k = j + 1
                while k < n and not spaced(k):
                    k += 1
                fields.append((j, k))
                j = k
            if len(fields) == 4 and j < n:
                if t[j] == "[":
                    while j < n and not (t[j] == "]" and spaced(j + 1)):
                        j += 1
                program = fields[1] if t[fields[1][0]] != "-" or fields[1][1] - fields[1][0] > 1 else (0, 0)
                return Roles(True, stamp, "", priority, program, (min(j + 1, n), -1), False)
        else:  # host, then program with its process in brackets
            j = i + 1
            while j < n and not spaced(j):
                j += 1
            k = j
            while k < n and t[k] not in "[:" and (k == j or not spaced(k)):
                k += 1
            if k > j and k < n and t[k] in "[:":
                e = k
                while t[e] != ":" and e + 1 < n:
                    e += 1
                return Roles(True, stamp, "", priority, (j, k), (min(e + 1, n), -1), False)
        return Roles(True, stamp, "", priority, (0, 0), (i, -1), False)
    if found.first == 1 and t[0] in LETTERS:  # level letter before the date; thread, file and line up to a bracket
        j = i
        while j < n and t[j] != "]":
            j += 1
        k = i + 1 if i < n and t[i].isdigit() else i
        e = k
        while e < j and t[e] not in ".:" and (e == k or not spaced(e)):
            e += 1
        return Roles(True, stamp, LETTERS[t[0]], -1, (k, e) if j < n else (0, 0), (min(j + 1, n) if j < n else i, -1), False)

    level, component, elements = "", (0, 0), 0
    while i < n:
        c = t[i]
        if c in "-|" and (spaced(i) or c == "|") and (spaced(i + 1) or c == "|"):
            i += 1
            elements += 1
            if level and component[1]:
                break
            continue
        if c == "[":
            j = i + 1
            while j < n and t[j] != "]" and j - i < HEAD_TOKENS:
                j += 1
            if j >= n or t[j] != "]":
                break
            if j == i + 2 and not level and is_level(i + 1):
                level = level_of(t[i + 1])
            elif has_digits(i):
                pass  # a thread or process
            elif not component[1] and t[i + 1][0].isalpha():
                component = (i + 1, j)
            elif elements:
                break
            i = j + 1
            elements += 1
            continue
        if c.isdigit() and i + 3 < n and t[i + 1] == "#" and t[i + 2].isdigit() and t[i + 3] == ":":
            i += 4  # process and thread, then a connection
            if i + 1 < n and t[i] == "*" and t[i + 1].isdigit():
                i += 2
            break
        if not level and is_level(i) and (elements == 0 or t[i + 1 : i + 2] == [":"] or t[i + 1 : i + 2] == ["|"] or t[i + 1 : i + 2] == ["-"] and spaced(i + 1)):
            level = level_of(t[i])
            i += 1
            elements += 1
            if i < n and t[i] == ":" and not spaced(i):
                i += 1
                break
            continue
        if component[1] or not (t[i][0].isalpha() or t[i][0] == "_"):
            break
        j = i + 1
        while j < n and not spaced(j) and t[j] not in "[:|=,;(\"'":
            j += 1
        k = j
        while k < n and k - i < 8 and not is_level(k) and (t[k][0].isalpha() or t[k] in "-._"):
            k += 1  # a name of several words, up to a level and its colon
        if k > j and spaced(k) and is_level(k) and t[k + 1 : k + 2] == [":"]:
            component, i = (i, k), k
            elements += 1
            continue
        k = j
        if k < n and t[k] == "[" and not spaced(k):  # its process
            while k < n and t[k] != "]":
                k += 1
            k += 1
        if k < n and t[k] == ":" and not spaced(k) and spaced(k + 1):
            component, i = (i, j), k + 1
            break
        if k < n and (t[k] in "-|" and (spaced(k) and spaced(k + 1) or t[k] == "|") or spaced(k) and is_level(k) and t[k + 1 : k + 2] == [":"]):
            component, i = (i, j), k
            elements += 1
            continue
        break
    if not component[1]:  # a component key among the constants of the message
        for k in range(i, n - 1):
            if t[k] in COMPONENT_KEYS and t[k + 1] == ":" and k and t[k - 1] == ",":
                e = k + 2
                while e < n and t[e] != "," and (e == k + 2 or not spaced(e)):
                    e += 1
                component = (k + 2, e)
    return Roles(True, stamp, level, -1, component, (i, -1), False)
