"""Where results go: files, and texts for people."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a text for people holds at most unless asked otherwise; files hold all.
SHOWN = 10_000


def write(df: DataFrame, path: str, how: str = "ndjson") -> None:
    w = df.write.mode("append")
    if how in ("json", "ndjson"):
        w.json(path)
    elif how in ("csv", "tsv"):
        flat = df.select(*(F.to_json(f"`{n}`").alias(n) if t.startswith(("array", "map", "struct", "variant")) else F.col(f"`{n}`") for n, t in df.dtypes))
        flat.write.mode("append").option("sep", "\t" if how == "tsv" else ",").option("header", True).csv(path)
    elif how in ("parquet", "orc"):
        w.format(how).save(path)
    elif how == "raw":
        df.select(F.col("_raw").cast("string").alias("value")).write.mode("append").text(path)
    else:
        raise ValueError(f"there is no sink {how}")


def render(df: DataFrame, how: str = "table", rows: int = SHOWN) -> str:
    """table, box, ascii, markdown, json, ndjson, csv, tsv, vertical (or G), line or raw; auto is vertical for one row, else table.

    A text of more rows than asked for ends with a line that says so; json, which has no place for one, raises.
    """
    names = df.columns
    found = df.limit(rows + 1).collect()
    data, more = [list(r) for r in found[:rows]], len(found) > rows
    if more and how == "json":
        raise ValueError(f"more than {rows} rows: write them to files, or ask for more")
    text = _rendered(names, data, how)
    return text + f"\n... more than {rows} rows, the others aren't shown" if more else text


def _rendered(names: list[str], data: list[list], how: str) -> str:
    how = {"G": "vertical"}.get(how, how)
    if how == "auto":
        how = "vertical" if len(data) == 1 else "table"
    say = lambda v: "" if v is None else v.isoformat() if hasattr(v, "isoformat") else v if isinstance(v, str) else json.dumps(v, default=str)
    if how in ("json", "ndjson"):
        objects = [json.dumps(dict(zip(names, r)), default=say, ensure_ascii=False) for r in data]
        return "[" + ",\n".join(objects) + "]" if how == "json" else "\n".join(objects)
    if how in ("csv", "tsv"):
        import csv
        import io

        out = io.StringIO()
        csv.writer(out, delimiter="\t" if how == "tsv" else ",", lineterminator="\n").writerows([names, *([say(v) for v in r] for r in data)])
        return out.getvalue().rstrip("\n")
    if how == "vertical":
        wide = max(map(len, names), default=0)
        return "\n\n".join("\n".join(f"{n:>{wide}}: {say(v)}" for n, v in zip(names, r)) for r in data)
    if how == "line":
        return "\n".join(" ".join(f"{n}={say(v)}" for n, v in zip(names, r)) for r in data)
    if how == "raw":
        return "\n".join(say(r[names.index("_raw")] if "_raw" in names else r[0]) for r in data)
    cells = [names, *([say(v) for v in r] for r in data)]
    wide = [max(len(r[i]) for r in cells) for i in range(len(names))]
    if how in ("box", "ascii"):
        across, up, joints = ("─", "│", "┌┬┐├┼┤└┴┘") if how == "box" else ("-", "|", "+++++++++")
        bar = lambda k: joints[k] + joints[k + 1].join(across * (w + 2) for w in wide) + joints[k + 2]
        body = [up + up.join(f" {c.ljust(w)} " for c, w in zip(r, wide)) + up for r in cells]
        return "\n".join([bar(0), body[0], bar(3), *body[1:], bar(6)])
    lines = [" | ".join(c.ljust(w) for c, w in zip(r, wide)) for r in cells]
    rule = "-|-".join("-" * w for w in wide)
    if how == "markdown":
        return "\n".join(f"| {x} |" for x in [lines[0], rule, *lines[1:]])
    return "\n".join([lines[0], rule, *lines[1:]])
