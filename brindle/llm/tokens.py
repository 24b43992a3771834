"""Sizes of texts in tokens of a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vocabulary of a byte-level BPE as ranks; the file stays where it is.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How that vocabulary's texts are cut into pieces before merging (fixed value).
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

_loaded: dict = {}


def encoding(path: str):
    if path not in _loaded:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("public", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def sized(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source, copy_of (hash of the text) and tokens. Null and empty texts have 0 tokens."""

    def run(batches):
        import pyarrow as pa

        enc = encoding(vocabulary)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(n, pa.int64())], names=["doc_id", "source", "copy_of", "tokens"])

    narrow = documents.select(F.col("doc_id").cast("bigint"), F.coalesce("source", F.lit("")).alias("source"), F.md5(F.coalesce("text", F.lit(""))).alias("copy_of"), F.col("text").cast("string"))
    return narrow.mapInArrow(run, "doc_id bigint, source string, copy_of string, tokens bigint")
