"""Semi-structured log lines into entries with timestamp, level, component and message.

Each line becomes a sequence of symbols: its words and marks as they are, numbers and
identifiers with digits as such. Distinct sequences are clustered by their longest common
subsequence, in rounds whose groups follow from the sequences alone: parts of one form, one
form, parts of one start, one start. The rounds are the same for any number of lines. What a
template's lines share are its constant slots, the rest its variable ones. Each slot is then typed by the values it holds over all sequences of the
template (timestamp, level, number, text), and the roles of a line's tokens follow from the
types and constants of their slots: whether it begins an entry, its level, its component
and where its message begins. Continuation lines are attached by line number in blocks, so
that one source may hold any share of the rows.

Defined results:
- null, empty and blank lines, and lines of any length whose template has no timestamp slot
  in its head, belong to the entry before them; so does a line whose own text is no date
  and time there, whatever its template;
- lines of a source before its first entry belong to none;
- null source is a source of its own; a line whose line_no is null is placed before its source's first line;
- a line that occurs twice under one line_no counts as two lines, begins at most one entry (smallest line_id);
- an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from operator import eq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions.slots import GAP, HEAD_TOKENS, MOST, SEVERITY, SOME, form
from brindle.plans.shared import list_path, remove_path, small_side, work_path

#: Share of the longer sequence that two must have in common to become one template.
TAU = 0.6
#: Sequences of one clustering task (where groups are placed, not what they hold), and lines of a source in one window.
SHARD_ITEMS, SHARD_BYTES, BLOCK_LINES = 4_000, 64 << 20, 50_000
#: Cells of an exact table of common subsequences; longer pairs are split at symbols both hold once.
CELLS = 4_000_000
#: Symbols at the start of a line whose form two lines of one template share: heads come first.
START = 8
#: Parts into which the sequences of one form, and the templates of one start, are cut by their hash before they meet.
FORM_PARTS, START_PARTS = 1_024, 64
#: Templates of one form that are compared one by one; more of them are looked up by symbol and position.
FEW = 16
#: Between symbols, and before the form of a start.
_SEP, _START = "\x1f", "\x1e"


def lcs(a: list[str], b: list[str]) -> list[int]:
    """Positions in a of a longest common subsequence of a and b (of very long ones: of a common subsequence)."""
    n, m = len(a), len(b)
    low = 0
    while low < min(n, m) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(n, m) - low and a[n - 1 - high] == b[m - 1 - high]:
        high += 1
    ends = [*range(low)], [*range(n - high, n)]
    if low or high:
        a, b = a[low : n - high], b[low : m - high]
        n, m = len(a), len(b)
    if n * m > CELLS:
        return [*ends[0], *(low + i for i in _anchored(a, b)), *ends[1]]
    rows = [[0] * (m + 1)]
    for x in a:
        last, row = rows[-1], [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(row[j], last[j + 1]))
        rows.append(row)
    out, i, j = [], n, m
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.append(low + i - 1)
            i, j = i - 1, j - 1
        elif rows[i - 1][j] >= rows[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return [*ends[0], *out[::-1], *ends[1]]


def _anchored(a: list[str], b: list[str]) -> list[int]:
    """Positions in a of the longest rising run of symbols that a and b hold once each."""
    from bisect import bisect_left

    once_a, once_b = Counter(a), Counter(b)
    at = {y: j for j, y in enumerate(b) if once_b[y] == 1}
    tails: list[int] = []
    last: list[int] = []
    before: dict[int, int] = {}
    for i, x in enumerate(a):
        if once_a[x] == 1 and x in at:
            k = bisect_left(tails, at[x])
            before[i] = last[k - 1] if k else -1
            tails[k : k + 1], last[k : k + 1] = [at[x]], [i]
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def masks_of(a: list[str]) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, x in enumerate(a):
        out[x] = out.get(x, 0) | 1 << i
    return out


def lcs_length(masks: dict[str, int], n: int, b: list[str]) -> int:
    """Length of a longest common subsequence of b and the sequence of n symbols that masks stands for, a row at a time in one integer."""
    whole = (1 << n) - 1
    v = whole
    for y in b:
        u = v & masks.get(y, 0)
        v = (v + u | v - u) & whole
    return n - v.bit_count()


def _split(a: list[str]) -> tuple[list[str], list[bool]]:
    """The constants of a, and whether a gap stands before each of them and at the end."""
    constants, gaps = [], [False]
    for x in a:
        if x == GAP:
            gaps[-1] = True
        else:
            constants.append(x)
            gaps.append(False)
    return constants, gaps


def merged(a: list[str], b: list[str]) -> list[str]:
    """What a and b have in common, with <*> for each gap; gaps of either remain."""
    (a, in_a), (b, in_b) = _split(a), _split(b)
    out, at, bt = [], 0, 0
    for i in [*lcs(a, b), len(a)]:
        j = b.index(a[i], bt) if i < len(a) else len(b)
        if i > at or j > bt or any(in_a[at : i + 1]) or any(in_b[bt : j + 1]):
            out.append(GAP)
        out += a[i : i + 1]
        at, bt = i + 1, j + 1
    return out


def mine(sequences: list[list[str]], tau: float = TAU) -> tuple[list[int], list[list[str]]]:
    """Cluster sequences in the order given. Returns for each the number of its template, and the templates.

    A sequence joins the template with which it has most in common, if that is at least tau
    of the longer of the two; the template keeps what both share.
    """
    from brindle.functions.slots import aligned

    templates: list[list[str]] = []
    constants: list[list[str]] = []  # of each template, without its gaps
    bags: list[Counter] = []
    masks: list[dict[str, int]] = []
    holding: dict[str, list[int]] = {}  # templates that held a symbol when they were made; merging only takes symbols away
    of: list[int] = []
    for s in sequences:
        own = [x for x in s if x != GAP]
        best, common, bag = -1, 0, Counter(own)
        # a template with enough in common holds one of any so many symbols of s: the rarest are looked up
        spare = len(own) - math.ceil(tau * len(s)) + 1
        rare = sorted(bag, key=lambda x: len(holding.get(x, ())))
        looked, k = [], 0
        while k < len(rare) and spare > 0:
            looked.append(rare[k])
            spare -= bag[rare[k]]
            k += 1
        for k in sorted({k for x in looked for k in holding.get(x, ())}):
            c = constants[k]
            need = tau * max(len(s), len(c))
            if min(len(own), len(c)) < need or min(len(own), len(c)) <= common:
                continue
            other = bags[k]
            shared = sum(min(n, other[x]) for x, n in bag.items() if x in other)  # no common subsequence is longer
            if shared < need or shared <= common:
                continue
            n = lcs_length(masks[k], len(c), own)
            if n >= need and n > common:
                best, common = k, n
        if best < 0:
            templates.append(list(s))
            constants.append(own)
            bags.append(bag)
            masks.append(masks_of(own))
            best = len(templates) - 1
            for x in bag:
                holding.setdefault(x, []).append(best)
        elif templates[best] != s and (GAP in s or aligned(templates[best], s) is None):
            templates[best] = merged(templates[best], s)
            constants[best] = [x for x in templates[best] if x != GAP]
            bags[best] = Counter(constants[best])
            masks[best] = masks_of(constants[best])
        of.append(best)
    return of, templates


def _form(s: list[str]) -> str:
    return _SEP.join(map(form, s))


def started(s: list[str]) -> list[str]:
    """s behind one more symbol, the form of its start."""
    return [_START + _form(s[:START]).replace(_SEP, ""), *s]


def cluster(sequences: list[list[str]], tau: float = TAU) -> tuple[list[int], list[list[str]]]:
    """mine, for sequences of each start (their first symbol) by themselves."""
    starts: dict[str, list[int]] = {}
    for i, s in enumerate(sequences):
        starts.setdefault(s[0], []).append(i)
    of = [0] * len(sequences)
    templates: list[list[str]] = []
    for start, members in starts.items():
        into, made = _cluster([sequences[i][1:] for i in members], tau)
        for i, k in zip(members, into):
            of[i] = len(templates) + k
        templates += [[start, *t] for t in made]
    return of, templates


def _cluster(sequences: list[list[str]], tau: float) -> tuple[list[int], list[list[str]]]:
    """mine, after sequences of one form (which differ in words alone) have been clustered position by position."""
    forms: dict[str, list[int]] = {}
    for i, s in enumerate(sequences):
        forms.setdefault(_form(s), []).append(i)
    parts: list[list[str]] = []
    of = [0] * len(sequences)
    for members in forms.values():
        into, made = alike([sequences[i] for i in members], tau)
        for i, k in zip(members, into):
            of[i] = len(parts) + k
        parts += made
    shut = [closed(p) for p in parts]
    ranked = sorted(range(len(shut)), key=lambda k: (len(shut[k]), shut[k]))
    into, templates = mine([shut[k] for k in ranked], tau)
    place = dict(zip(ranked, into))
    return [place[k] for k in of], templates


def alike(sequences: list[list[str]], tau: float = TAU) -> tuple[list[int], list[list[str]]]:
    """Cluster sequences of one form and length, or their templates, position by position; the templates are as long as they.

    Equal symbols at equal positions are a common subsequence, so tau holds for those too.
    """
    parts: list[list[str]] = []
    holding: dict[tuple[int, str], list[int]] = {}  # as in mine
    of: list[int] = []
    for s in sequences:
        own = [None if x == GAP else x for x in s]
        need = math.ceil(tau * len(s))
        near = range(len(parts))
        if len(parts) > FEW:
            places = sorted(((i, x) for i, x in enumerate(own) if x is not None), key=lambda p: len(holding.get(p, ())))
            near = sorted({k for p in places[: max(0, len(places) - need + 1)] for k in holding.get(p, ())})
        best, common = -1, -1
        for k in near:
            same = sum(map(eq, parts[k], own))
            if same > common:
                best, common = k, same
        if best < 0 or common < need:
            best = len(parts)
            parts.append(s)
            for p in enumerate(own):
                if p[1] is not None:
                    holding.setdefault(p, []).append(best)
        elif common < len(s):
            parts[best] = [x if x == y else GAP for x, y in zip(parts[best], own)]
        of.append(best)
    return of, parts


def closed(part: list[str]) -> list[str]:
    """A template of alike with one gap for each run of them."""
    return [x for i, x in enumerate(part) if x != GAP or i == 0 or part[i - 1] != GAP]


LINE = "key binary, sig string, form binary, at array<int>"


def tokenised(lines: DataFrame, first_line: bool = False) -> DataFrame:
    """lines (any keys, event) with key (hash of the symbols), at (where tokens begin), sig, the symbols, and form, the hash of their form.

    sig and form are given where a task meets a sequence for the first time and null elsewhere, so
    that equal sequences are combined before they are shuffled; blank lines have no key.
    With first_line an event of several lines is read by its first one, as its head stands there.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema.fields)

    def run(batches):
        import pyarrow as pa

        from brindle.functions.slots import tokenised as read

        known: dict[tuple, bytes] = {}
        for b in batches:
            if len(known) > 200_000:  # bounds a worker's memory; a sequence may then be given again
                known.clear()
            keys, sigs, forms, ats = [], [], [], []
            for e in b.column("event").to_pylist():
                key = sig = kind = at = None
                if e and not e.isspace():
                    x = read(e.split("\n", 1)[0] if first_line else e)
                    symbols, at = tuple(x.symbols), x.at
                    key = known.get(symbols)
                    if key is None and symbols:
                        sig = _SEP.join(started(x.symbols))
                        key = known[symbols] = digest(sig)
                        kind = digest(_form(x.symbols))
                keys.append(key)
                sigs.append(sig)
                forms.append(kind)
                ats.append(at)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(keys, pa.binary()), pa.array(sigs, pa.string()), pa.array(forms, pa.binary()), pa.array(ats, pa.list_(pa.int32()))], names=[*b.schema.names, "key", "sig", "form", "at"]
            )

    return lines.mapInArrow(run, f"{fields}, {LINE}")


def digest(text: str, more: bytes = b"") -> bytes:
    from hashlib import blake2b

    return blake2b(text.encode("utf-8", "surrogatepass") + more, digest_size=16).digest()


def _of_form(sequences: list[list[str]], tau: float) -> tuple[list[int], list[list[str]]]:
    """alike, behind the start that sequences of one form share."""
    of, parts = alike([s[1:] for s in sequences], tau)
    return of, [[sequences[0][0], *p] for p in parts]


def _closed_of_form(sequences: list[list[str]], tau: float) -> tuple[list[int], list[list[str]]]:
    of, parts = _of_form(sequences, tau)
    return of, [closed(p) for p in parts]


#: The rounds: columns that name a group, into how many parts it is cut by hash, and how its members are clustered.
ROUNDS = (("form", FORM_PARTS, _of_form), ("form", 1, _closed_of_form), ("start", START_PARTS, cluster), ("start", 1, cluster))


def _round(items: DataFrame, k: int, shards: int, tau: float) -> DataFrame:
    """(key, to, form, template): the template, named to, of each of items (key, form, sig) after round k; its text stands in one row of its group.

    A group follows from its members alone; shards only say which task holds it.
    """
    column, parts, step = ROUNDS[k]
    group = [F.col("form") if column == "form" else F.substring_index("sig", _SEP, 1), F.pmod(F.xxhash64("key"), F.lit(parts))]
    shard = F.pmod(F.xxhash64(*group, F.lit(k)), F.lit(shards))
    cut = k == 0  # gaps are as long as what they stand for, so that one text may belong to several forms

    def run(pdf):
        pdf = pdf.drop_duplicates("key").sort_values("sig")
        groups: dict[tuple, list[tuple]] = {}
        for key, form, sig, part in zip(pdf["key"], pdf["form"], pdf["sig"], pdf["part"]):
            s = sig.split(_SEP)
            groups.setdefault((form if column == "form" else s[0], part), []).append((key, form, s))
        out = []
        for members in groups.values():
            form = members[0][1]
            of, templates = step([s for _, _, s in members], tau)
            made = [_SEP.join(t) for t in templates]
            names = [digest(t, form if cut else b"") for t in made]
            seen: set[int] = set()
            for (key, _, _), t in zip(members, of):
                out.append((key, names[t], form, None if t in seen else made[t]))
                seen.add(t)
        return type(pdf)(out, columns=["key", "to", "form", "template"])

    return items.select("key", "form", "sig", group[1].alias("part"), shard.alias("shard")).groupBy("shard").applyInPandas(run, "key binary, to binary, form binary, template string")


def mine_templates(spark: SparkSession, lines: DataFrame, at: str, tau: float = TAU, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(key, event, template) of each distinct sequence in lines, with the least of its events, written below at.

    All rounds run whatever the size of the input, to the end, so that a template follows
    from the distinct sequences alone. shard_items and SHARD_BYTES only set the number of tasks.
    """
    items = lines.filter("sig is not null").select("key", "form", "sig")
    count, size = items.agg(F.count("*"), F.coalesce(F.sum(F.length("sig")), F.lit(0))).first()
    shards = max(1, -(-count // shard_items), -(-size // SHARD_BYTES))
    found = None
    for k in range(len(ROUNDS)):
        _round(items, k, shards, tau).write.parquet(f"{at}/round{k}")
        step = spark.read.parquet(f"{at}/round{k}")
        into = small_side(step.select(F.col("key").alias("to"), F.col("to").alias("next"))) if k else None
        found = step.select("key", "to") if found is None else found.join(into, "to").select("key", F.col("next").alias("to"))
        items = step.filter("template is not null").select(F.col("to").alias("key"), "form", F.col("template").alias("sig"))
    texts = items.groupBy(F.col("key").alias("to")).agg(F.first("sig").alias("template"))
    events = lines.filter("key is not null").groupBy("key").agg(F.min("event").alias("event"))
    events.join(found.join(small_side(texts), "to").select("key", "template"), "key").write.parquet(f"{at}/shapes")
    return spark.read.parquet(f"{at}/shapes")


def slot_types(shapes: DataFrame, first_line: bool = False) -> DataFrame:
    """(template, n, begins, levels, digits): what the slots of each template hold, over all of its sequences.

    begins is the share of sequences that have a timestamp in their head; levels and digits
    are the places behind the timestamp whose values are levels, or have digits.
    """

    def run(batches):
        import pyarrow as pa

        from brindle.functions import slots as S

        for b in batches:
            coded = b.column("template").dictionary_encode()
            texts = coded.dictionary.to_pylist()
            slots_of: list[list[str] | None] = [None] * len(texts)
            found: dict[tuple[int, str], list[int]] = {}
            for event, code in zip(b.column("event").to_pylist(), coded.indices.to_pylist()):
                x = S.tokenised(event.split("\n", 1)[0] if first_line else event)
                stamp = S.stamp_of(x)
                all_ = found.setdefault((code, ""), [0, 0, 0])
                all_[0] += 1
                if stamp is None:
                    continue
                all_[1] += 1
                if stamp.pairs is not None:
                    continue
                if slots_of[code] is None:
                    slots_of[code] = texts[code].split(_SEP)[1:]
                slots = S.aligned(slots_of[code], x.symbols)
                if slots is None:
                    continue
                high = min(len(slots), stamp.end + HEAD_TOKENS)
                for i, place in zip(range(stamp.end, high), S.places(slots, x.symbols, stamp.end, high)):
                    t = S.held(x, i)
                    if t:
                        c = found.setdefault((code, place), [0, 0, 0])
                        c[0] += 1
                        c[1] += bool(S.level_of(t))
                        c[2] += any(map(str.isdigit, t))
            rows = [(texts[t], p, *c) for (t, p), c in found.items()]
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], names=["template", "place", "n", "levels", "digits"])

    each = shapes.select("event", "template").mapInArrow(run, "template string, place string, n bigint, levels bigint, digits bigint")
    counted = each.groupBy("template", "place").agg(F.sum("n").alias("n"), F.sum("levels").alias("levels"), F.sum("digits").alias("digits"))
    here = F.col("place") == ""
    # places are named by position and the marks beside them: few for each template, however many lines it has
    named = lambda test: F.sort_array(F.collect_list(F.when(~here & test, F.col("place"))))
    return counted.groupBy("template").agg(
        F.max(F.when(here, F.col("n"))).alias("n"), F.max(F.when(here, F.col("levels") / F.col("n"))).alias("begins"),
        named(F.col("levels") >= SOME * F.col("n")).alias("levels"), named(F.col("digits") >= MOST * F.col("n")).alias("digits"),
    )


ROLES = "key binary, stamp_from int, stamp_to int, level string, priority int, component_from int, component_to int, message_from int, message_to int, json boolean, template string"


def slot_roles(shapes: DataFrame, types: DataFrame, first_line: bool = False) -> DataFrame:
    """One row for each sequence whose template begins entries: which of its tokens are stamp, priority, component and message, and its level."""
    known = types.filter(F.col("begins") >= MOST).select("template", "levels", "digits")
    typed = shapes.join(small_side(known), "template").select("key", "event", "template", "levels", "digits")

    def run(batches):
        import pyarrow as pa

        from brindle.functions import slots as S

        kinds = [pa.binary(), *[pa.int32()] * 2, pa.string(), *[pa.int32()] * 5, pa.bool_(), pa.string()]
        names = [w.split()[0] for w in ROLES.split(", ")]
        for b in batches:
            rows = []
            coded = b.column("template").dictionary_encode()
            texts = coded.dictionary.to_pylist()
            known: list[tuple[list[str], set, set] | None] = [None] * len(texts)
            has_level, has_digit = b.column("levels"), b.column("digits")
            for n, (key, event, code) in enumerate(zip(b.column("key").to_pylist(), b.column("event").to_pylist(), coded.indices.to_pylist())):
                x = S.tokenised(event.split("\n", 1)[0] if first_line else event)
                stamp = S.stamp_of(x)
                if stamp is None:
                    continue
                levels, digits = [], []
                if stamp.pairs is None:
                    if known[code] is None:
                        known[code] = texts[code].split(_SEP)[1:], set(has_level[n].as_py()), set(has_digit[n].as_py())
                    template, level_at, digit_at = known[code]
                    slots = S.aligned(template, x.symbols)
                    if slots is not None:
                        at = S.places(slots, x.symbols, stamp.end, min(len(slots), stamp.end + HEAD_TOKENS))
                        levels, digits = [p in level_at for p in at], [p in digit_at for p in at]
                r = S.roles(x, stamp, levels, digits)
                rows.append((key, *r.stamp, r.level, r.priority, *r.component, *r.message, r.json, texts[code]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names=names)

    return typed.mapInArrow(run, ROLES)


def mined(spark: SparkSession, lines: DataFrame, name: str, first_line: bool = False, tau: float = TAU, shard_items: int = SHARD_ITEMS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tokenised lines, templates with the types of their slots, roles of each sequence), all written in the shared folder."""
    at = work_path(spark, name)
    tokenised(lines, first_line).write.parquet(f"{at}/lines")
    found = spark.read.parquet(f"{at}/lines")
    shapes = mine_templates(spark, found, at, tau, shard_items)
    slot_types(shapes, first_line).write.parquet(f"{at}/types")
    types = spark.read.parquet(f"{at}/types")
    slot_roles(shapes, types, first_line).write.parquet(f"{at}/roles")
    for path in list_path(spark, at):
        if path.rsplit("/", 1)[-1].startswith(("round", "shapes")):
            remove_path(spark, path)
    return found, types, spark.read.parquet(f"{at}/roles")


#: A date's clock, or Unix time: what the text of a timestamp slot must hold in each line itself.
_CLOCK = r"(^|[^0-9])([01]?[0-9]|2[0-3]):[0-5][0-9]|[0-9][Tt ]?([01][0-9]|2[0-3])[0-5][0-9][0-5][0-9]([^0-9]|$)|^[0-9]{10,19}([.,][0-9]+)?$"


def with_roles(lines: DataFrame, roles: DataFrame) -> DataFrame:
    """lines with stamp, log_level, component, message and template; stamp and template are null for lines that begin no entry."""
    joined = lines.drop("sig", "form").join(small_side(roles), "key", "left")
    begin = lambda i: F.get("at", i)

    def part(low: str, high: str) -> Column:
        a, b = F.col(low), F.col(high)
        # up to the next token; white space before that one isn't part of it
        end = F.coalesce(begin(b), F.length("event"))
        return F.when(b > a, F.rtrim(F.substring("event", begin(a) + 1, end - begin(a))))

    stamp = part("stamp_from", "stamp_to")
    severity = F.element_at(F.array(*map(F.lit, SEVERITY)), (F.substring("event", begin(F.col("priority")) + 1, begin(F.col("priority") + 1) - begin(F.col("priority"))).try_cast("int") % 8 + 1))
    rest = F.when(begin(F.col("message_from")).isNotNull(), F.ltrim(F.substring("event", begin(F.col("message_from")) + 1, F.length("event")))).otherwise("")
    inside = F.coalesce(part("message_from", "message_to"), F.lit(""))
    plain = F.when(F.col("json"), F.coalesce(F.get_json_object(F.concat(F.lit('{"m":"'), inside, F.lit('"}')), "$.m"), inside)).otherwise(F.replace(inside, F.lit('\\"'), F.lit('"')))
    keep = [F.col(f"`{c}`") for c in lines.columns if c not in ("sig", "form", "key", "at")]
    step = joined.select(*keep, "template", stamp.alias("stamp"), F.when(F.col("priority") >= 0, F.coalesce(severity, F.lit(""))).otherwise(F.col("level")).alias("log_level"), F.coalesce(part("component_from", "component_to"), F.lit("")).alias("component"), F.when(F.col("message_to") < 0, rest).otherwise(plain).alias("message"))
    own = F.col("template").isNotNull() & F.coalesce(F.col("stamp").rlike(_CLOCK), F.lit(False))
    return step.select(*keep, *(F.when(own, F.col(c)).alias(c) for c in ("stamp", "log_level", "component", "message", "template")))


def _starts(lines: DataFrame, spark: SparkSession, tau: float = TAU, shard_items: int = SHARD_ITEMS) -> tuple[DataFrame, DataFrame]:
    """(starting lines with what their heads state and n_lines, blocks with what they carry over)."""
    narrow = lines.select(F.coalesce("source", F.lit("\0")).alias("source"), F.coalesce(F.col("line_no"), F.lit(0).cast("bigint")).alias("line_no"), "line_id", "received_at", "event")
    found, _, roles = mined(spark, narrow, "lines", tau=tau, shard_items=shard_items)
    marked = with_roles(found, roles).drop("event").withColumn("block", F.floor(F.col("line_no") / BLOCK_LINES))
    start = F.col("template").isNotNull()
    blocks = marked.groupBy("source", "block").agg(F.min(F.when(start, F.col("line_no"))).alias("first_start"), F.max(F.when(start, F.col("line_no"))).alias("last_start"), F.max("line_no").alias("end"))
    later = Window.partitionBy("source").orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = blocks.select(
        "source", "block",
        F.first("first_start", ignorenulls=True).over(later).alias("next_block_start"),
        F.last("last_start", ignorenulls=True).over(before).alias("carried_start"),
        F.max("end").over(Window.partitionBy("source")).alias("source_end"),
    )
    own = marked.filter(start).withColumn("rank", F.row_number().over(Window.partitionBy("source", "block", "line_no").orderBy("line_id"))).filter("rank = 1")
    ordered = Window.partitionBy("source", "block").orderBy("line_no")
    starts = own.withColumn("next", F.lead("line_no").over(ordered)).join(carry, ["source", "block"]).withColumn(
        "n_lines", F.coalesce("next", "next_block_start", F.col("source_end") + 1) - F.col("line_no")
    )
    return starts, carry


def found_entries(spark: SparkSession, lines: DataFrame, tau: float = TAU, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """line_id, n_lines, log_level, component of each entry of raw lines."""
    starts, _ = _starts(lines, spark, tau, shard_items)
    return starts.select("line_id", "n_lines", "log_level", "component")


def entries(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """Whole entries: source, line_id of the first line, n_lines, stamp, received_at, log_level, component, message (all lines)."""
    starts, carry = _starts(lines, spark)
    keyed = lines.select(F.coalesce("source", F.lit("\0")).alias("source"), F.coalesce(F.col("line_no"), F.lit(0).cast("bigint")).alias("line_no"), F.col("line_id").alias("id"), "event").withColumn("block", F.floor(F.col("line_no") / BLOCK_LINES))
    begins = starts.select("source", "block", "line_no", F.lit(True).alias("begin"))
    order = Window.partitionBy("source", "block").orderBy("line_no", F.col("id")).rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        keyed.join(begins.distinct(), ["source", "block", "line_no"], "left")
        .withColumn("start", F.last(F.when(F.col("begin"), F.col("line_no")), ignorenulls=True).over(order))
        .join(carry.select("source", "block", "carried_start"), ["source", "block"], "left")
        .withColumn("start", F.coalesce("start", "carried_start"))
        .filter("start is not null and line_no > start")
    )
    rest = placed.groupBy("source", F.col("start").alias("line_no")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "id", F.coalesce("event", F.lit("")).alias("e")))), lambda x: x.e), "\n").alias("rest"))
    return (
        starts.join(rest, ["source", "line_no"], "left")
        .select("source", "line_id", "n_lines", "stamp", "received_at", "log_level", "component", F.concat_ws("\n", "message", "rest").alias("message"), shown("template").alias("template"))
    )


def whole_entries(spark: SparkSession, events: DataFrame) -> DataFrame:
    """Rows that are whole entries already (keys, event): stamp, log_level, component and message of each.

    A text without a head of its own has null stamp, empty level and component, and is its message.
    """
    found, _, roles = mined(spark, events, "events", first_line=True)
    out = with_roles(found, roles)
    return out.select(
        *(F.col(f"`{c}`") for c in events.columns if c != "event"), "stamp",
        F.coalesce("log_level", F.lit("")).alias("log_level"), F.coalesce("component", F.lit("")).alias("component"), F.coalesce("message", "event").alias("message"),
    )


def shown(template) -> Column:
    """A template as readable text."""
    return F.regexp_replace(F.col(template) if isinstance(template, str) else template, f"^{_START}[^{_SEP}]*|{_SEP}", "")


def template_report(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """template, begins, n_lines, n_shapes: the templates of lines (line_id, event) and whether they begin entries."""
    at = work_path(spark, "templates")
    tokenised(lines).write.parquet(f"{at}/lines")
    found = spark.read.parquet(f"{at}/lines")
    shapes = mine_templates(spark, found, at)
    counted = found.filter("key is not null").groupBy("key").agg(F.count("*").alias("n"))
    types = slot_types(shapes).select("template", (F.col("begins") >= MOST).alias("begins"))
    return counted.join(shapes.select("key", "template"), "key").groupBy("template").agg(F.sum("n").alias("n_lines"), F.count("*").alias("n_shapes")).join(types, "template").select(shown("template").alias("template"), "begins", "n_lines", "n_shapes")
