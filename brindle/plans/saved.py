"""Saved queries and fragments: texts under names, kept as small files where the engine has a store."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator, MutableMapping
from urllib.parse import quote

from pyspark.sql import SparkSession

from brindle.plans.shared import list_path, read_text, remove_path, write_text
from brindle.plans.syntax import parse


class Saved(MutableMapping):
    """A dict of query texts. A text that doesn't parse isn't saved; what another session saved is there."""

    def __init__(self, spark: SparkSession, store: str | None, kind: str):
        self.spark, self.folder = spark, f"{store.rstrip('/')}/{kind}" if store else None
        self.entries: dict[str, dict] = {}
        for file in list_path(spark, self.folder) if self.folder else ():
            entry = json.loads(read_text(spark, file))
            self.entries[entry["name"]] = entry

    def _file(self, name: str) -> str:
        return f"{self.folder}/{quote(name, safe='')}.json"

    def __setitem__(self, name: str, text: str) -> None:
        parse(text)
        now = dt.datetime.now(dt.UTC).isoformat()
        entry = {"name": name, "text": text, "created": self.entries.get(name, {}).get("created", now), "updated": now}
        if self.folder:
            write_text(self.spark, self._file(name), json.dumps(entry))
        self.entries[name] = entry

    def __getitem__(self, name: str) -> str:
        return self.entries[name]["text"]

    def __delitem__(self, name: str) -> None:
        del self.entries[name]
        if self.folder:
            remove_path(self.spark, self._file(name))

    def __iter__(self) -> Iterator[str]:
        return iter(sorted(self.entries))

    def __len__(self) -> int:
        return len(self.entries)

    def list(self) -> list[dict]:
        return [self.entries[n] for n in self]
