"""Filling fixed-capacity containers with items: conflict-constrained best fit.

Items are hashed into shards of a bounded number of items; each shard is packed by
decreasing size. Its open bins are ordered by residual capacity and carry two bitmaps:
the sources and the duplicate clusters they hold. The search starts at the tightest bin
that is large enough and goes on through all of its successors until one is compatible,
that is holds neither a copy of the same text nor the same source. If no open bin is, the
tightest one without a copy is taken, since more items than sources must share a large
container; copies never meet unless a shard holds more of them than containers can be
filled with: then as few as possible do. fill_report counts both. An item larger than the capacity is split at it, nothing else is.

Defined results: null and empty texts have no tokens and go into no container; a capacity
that is null or below 1 packs nothing; equal sizes are taken in order of doc_id; a doc_id
that occurs twice is two items; empty tables give empty results.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.tokens import VOCABULARY, sized
from brindle.plans.shared import work_path

SHARD_ITEMS = 20_000


def best_fit(items: list[tuple[int, int, int]], capacity: int) -> list[int]:
    """The bin of each item (size, source bit, cluster bit or 0); items must be ordered by decreasing size."""
    open_: list[tuple[int, int]] = []  # (residual, bin)
    sources: list[int] = []
    clusters: list[int] = []
    smallest = items[-1][0] if items else 0
    out = []
    for size, source, cluster in items:
        chosen = second = -1
        for at in range(bisect_left(open_, (size, -1)), len(open_)):
            b = open_[at][1]
            if clusters[b] & cluster:
                continue
            if not sources[b] & source:
                chosen = at
                break
            if second < 0:
                second = at
        chosen = second if chosen < 0 else chosen
        if chosen < 0:
            residual, b = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        else:
            residual, b = open_.pop(chosen)
        sources[b] |= source
        clusters[b] |= cluster
        if residual - size >= smallest:
            insort(open_, (residual - size, b))
        out.append(b)
    return out


def _pack(pdf):
    import pandas as pd

    pack, shard, capacity = pdf["pack_id"].iat[0], int(pdf["shard"].iat[0]), int(pdf["capacity"].iat[0])
    pdf = pdf.sort_values(["size", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
    names = {s: 1 << k for k, s in enumerate(pdf["source"].unique())}
    # a cluster with more copies than there are containers to be filled counts as several: no more copies meet than must
    fewest = max(1, int(0.9 * pdf["size"].sum() / capacity))
    part = pdf.groupby("copy_of").cumcount() // fewest
    cluster = pdf["copy_of"] + "/" + part.astype(str)
    seen = cluster.value_counts()
    many = {c: 1 << k for k, c in enumerate(seen.index[seen > 1])}
    bins = best_fit([(n, names[s], many.get(c, 0)) for n, s, c in zip(pdf["size"].tolist(), pdf["source"], cluster)], capacity)
    return pd.DataFrame({"pack_id": pack, "container": [f"{shard:06d}-{b:06d}" for b in bins], "doc_id": pdf["doc_id"].to_numpy(), "piece": pdf["piece"].to_numpy(), "start_token": pdf["start_token"].to_numpy(), "tokens": pdf["size"].to_numpy()})


def packed(spark: SparkSession, documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """pack_id, container, doc_id, piece, start_token, tokens: every token of every text in exactly one container of each target."""
    at = work_path(spark, "sizes")
    sized(documents, vocabulary).filter("tokens > 0").write.parquet(at)
    sizes = spark.read.parquet(at)
    schema = "pack_id string, container string, doc_id bigint, piece bigint, start_token bigint, tokens bigint"
    shards = max(1, -(-sizes.count() // shard_items))
    # one row, which holds all targets
    wanted = targets.filter("capacity_tokens >= 1 and pack_id is not null").select("pack_id", F.col("capacity_tokens").cast("bigint").alias("capacity")).distinct()
    pieces = (
        sizes.select("doc_id", "source", "copy_of", "tokens").join(F.broadcast(wanted.agg(F.collect_list(F.struct("pack_id", "capacity")).alias("targets"))))
        .select("doc_id", "source", "copy_of", "tokens", F.explode("targets").alias("t")).select("doc_id", "source", "copy_of", "tokens", "t.*")
        .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("(tokens - 1) div capacity"))))
        .withColumn("start_token", F.col("piece") * F.col("capacity"))
        .withColumn("size", F.least("capacity", F.col("tokens") - F.col("start_token")))
        .withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", F.lit(7)), F.lit(shards)))
    )
    return pieces.groupBy("pack_id", "shard").applyInPandas(_pack, schema)


def fill_report(packs: DataFrame, targets: DataFrame, documents: DataFrame) -> DataFrame:
    """pack_id, containers, items, tokens, fill (share of all capacity that is used), and items that share a container with their source or with a copy of their text."""
    named = documents.select(F.col("doc_id").cast("bigint"), F.coalesce("source", F.lit("")).alias("source"), F.md5(F.coalesce("text", F.lit(""))).alias("copy_of")).dropDuplicates(["doc_id"])
    held = packs.join(named, "doc_id", "left")
    met = lambda c: held.groupBy("pack_id", "container", c).agg((F.count("*") - 1).alias("n")).groupBy("pack_id").agg(F.sum("n").alias(f"same_{c}"))
    of = packs.groupBy("pack_id", "container").agg(F.count("*").alias("k"), F.sum("tokens").alias("n")).groupBy("pack_id").agg(F.count("*").alias("containers"), F.sum("k").alias("items"), F.sum("n").alias("tokens"))
    fill = (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("fill")
    return of.join(targets, "pack_id").join(met("source"), "pack_id").join(met("copy_of"), "pack_id").select("pack_id", "containers", "items", "tokens", fill, "same_source", F.col("same_copy_of").alias("same_text"))
