"""Mixing sources to target weights by Sainte-Laguë apportionment.

The total of a mix is the largest at which sources that hold REACH of the weight (of those
with documents) can still give their share, so that one source that is far too small doesn't
starve the mix; it is cut into equal-token blocks. A source whose share is not below its
tokens times max_repeats is used up: every document of it is taken max_repeats times,
outside the blocks, and the others share the rest. Blocks go to the source with the highest
quotient weight / (2k + 1) until all are given; the report shows both shares. The tokens of
a source's quota are divided among its shards by their tokens, with what rounding cuts from
one carried to the next; in each shard documents are
taken in a seeded order, all of them once before any is taken again, and what a shard
leaves of its quota is carried on to the source's other shards.

Defined results: a source without documents gets no block and is reported with share 0;
weights that are null or not above 0 count as 0; max_repeats below 1 or null: not used;
a source named twice in a mix: weights add up and the larger max_repeats holds; texts
without tokens are never chosen; empty tables give empty results.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.tokens import VOCABULARY, sized
from brindle.plans.shared import small_side, work_path

BLOCKS = 10_000
REACH = 0.9
SHARD_ITEMS = 50_000


def sainte_lague(weights: list[float], caps: list[int], blocks: int) -> list[int]:
    """Blocks of each claimant, by highest quotients, none above its cap; ties go to the first."""
    out = [0] * len(weights)
    queue = [(-w, i) for i, w in enumerate(weights) if w > 0 and caps[i] > 0]
    heapq.heapify(queue)
    while blocks and queue:
        _, i = heapq.heappop(queue)
        out[i] += 1
        blocks -= 1
        if out[i] < caps[i]:
            heapq.heappush(queue, (-weights[i] / (2 * out[i] + 1), i))
    return out


def total_tokens(weights: list[float], limits: list[float], reach: float = REACH) -> float:
    """The largest total for which sources with at least reach of the weight stay within their limits."""
    live = [(limit / w, w) for w, limit in zip(weights, limits) if w > 0 and limit > 0]
    whole = sum(w for _, w in live)
    left, best = whole, 0.0
    for ratio, w in sorted(live):
        if left >= reach * whole * (1 - 1e-12):
            best = ratio * whole
        left -= w
    return best


def source_quotas(weights: list[float], limits: list[int], blocks: int = BLOCKS, reach: float = REACH) -> tuple[list[int], list[int]]:
    """(blocks, tokens) of each source. One whose share is not below its limit is used up: it gives exactly its limit, outside the blocks, and the others share the rest."""
    total = total_tokens(weights, [float(x) for x in limits], reach)
    size = max(1.0, total / blocks)  # tokens of a block
    live = [i for i, w in enumerate(weights) if w > 0 and limits[i] > 0] if total else []
    spent: set[int] = set()
    while True:
        open_, rest = [i for i in live if i not in spent], max(0.0, total - sum(limits[i] for i in spent))
        whole = sum(weights[i] for i in open_)
        full = {i for i in open_ if rest * weights[i] / whole >= limits[i] * (1 - 1e-12)}
        given = {}
        if not full:
            given = dict(zip(open_, sainte_lague([weights[i] for i in open_], [-(-limits[i] // size) for i in open_], round(rest / size))))
            full = {i for i in open_ if given[i] * size >= limits[i]}
        if not full:
            break
        spent |= full
    n = [round(limits[i] / size) if i in spent else int(given.get(i, 0)) for i in range(len(weights))]
    return n, [limits[i] if i in spent else int(given.get(i, 0) * size) for i in range(len(weights))]


def _quotas(blocks: int, reach: float):
    """Quotas of the sources of one mix, which are as many as its targets name."""

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("source")
        weights, limits = pdf["weight"].tolist(), [int(r) * int(t) for r, t in zip(pdf["max_repeats"], pdf["tokens"])]
        n, quotas = source_quotas(weights, limits, blocks, reach)
        whole = sum(weights)
        return pd.DataFrame({"mix_id": pdf["mix_id"], "source": pdf["source"], "target_share": [w / whole if whole else 0.0 for w in weights], "max_repeats": pdf["max_repeats"], "whole": pdf["tokens"], "n": n, "of": quotas})

    return run


def shard_quotas(quotas: DataFrame, totals: DataFrame) -> DataFrame:
    """Quotas (mix_id, source, target_share, max_repeats, whole, n, of) divided among shards (source, shard, tokens).

    What rounding cuts from one shard is carried to the next: the first k shards of a source
    have, together, the quota their tokens are worth, so a quota is given out to the last
    token, none above its shard's tokens times max_repeats, for any number of shards.
    """
    one = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    placed = totals.select("source", "shard", F.col("tokens").alias("available"), F.sum("tokens").over(one).alias("upto"))
    joined = quotas.join(placed, "source", "left").withColumns({"shard": F.coalesce("shard", F.lit(0).cast("bigint")), "available": F.coalesce("available", F.lit(0).cast("bigint"))})

    def part(c: str):
        upto = lambda x: f"(cast({c} as decimal(19,0)) * cast({x} as decimal(19,0))) div cast(whole as decimal(19,0))"
        return F.expr(f"case when whole > 0 then {upto('upto')} - {upto('(upto - available)')} else 0 end")

    return joined.select("mix_id", "source", "shard", "target_share", "max_repeats", "available", part("n").alias("blocks"), part("of").alias("quota"))


def planned(spark: SparkSession, documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, blocks: int = BLOCKS, reach: float = REACH, shard_items: int = SHARD_ITEMS) -> tuple[DataFrame, DataFrame]:
    """(documents with tokens and shard, quota of each mix, source and shard)."""
    at = work_path(spark, "sizes")
    sized(documents, vocabulary).filter("tokens > 0").write.parquet(at)
    sizes = spark.read.parquet(at)
    shards = max(1, -(-sizes.count() // shard_items))
    sharded = sizes.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(shards)))
    wanted = (
        targets.filter("mix_id is not null and source is not null")
        .groupBy("mix_id", "source")
        .agg(F.sum(F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))).alias("weight"), F.greatest(F.coalesce(F.max("max_repeats"), F.lit(0)), F.lit(0)).alias("max_repeats"))
    )
    totals = sharded.groupBy("source", "shard").agg(F.sum("tokens").alias("tokens"))
    claims = wanted.join(totals.groupBy("source").agg(F.sum("tokens").alias("tokens")), "source", "left").na.fill(0, ["tokens"])
    schema = "mix_id string, source string, target_share double, max_repeats int, whole bigint, n bigint, of bigint"
    quotas = claims.groupBy("mix_id").applyInPandas(_quotas(blocks, reach), schema)
    return sharded, shard_quotas(quotas, totals)


def mixed(spark: SparkSession, documents: DataFrame, targets: DataFrame, seed: int = 17, **options) -> tuple[DataFrame, DataFrame]:
    """(mix_id, source, doc_id, tokens, copies) and the quotas.

    In a shard every document is taken floor(quota / tokens of the shard) times, then once
    more each, in seeded order, whose tokens still fit into the rest. What the shards of a
    source leave of their quotas is given to as few of its shards as have room for it, and
    those are filled anew.
    """
    sharded, quotas = planned(spark, documents, targets, **options)
    at = work_path(spark, "quotas")
    quotas.write.parquet(at)
    quotas = spark.read.parquet(at)
    columns = ["mix_id", "source", "shard", "available", "quota", "max_repeats"]
    claimed = quotas.filter("quota > 0").select(columns)
    schema = "mix_id string, source string, shard bigint, doc_id bigint, tokens bigint, copies bigint"

    def chosen(claims):
        joined = sharded.join(small_side(claims), ["source", "shard"]).withColumn("turn", F.xxhash64("doc_id", F.lit(seed)))
        # one group is one shard of one source, of about shard_items rows at most
        return joined.select(*columns, "doc_id", "copy_of", "tokens", "turn").groupBy("mix_id", "source", "shard").applyInPandas(_select, schema)

    out = ["mix_id", "source", "doc_id", "tokens", "copies"]
    if quotas.groupBy("mix_id", "source").count().filter("count > 1").isEmpty():
        return chosen(claimed).select(out), quotas
    first = work_path(spark, "chosen")
    chosen(claimed).write.parquet(first)
    taken = spark.read.parquet(first)
    used = taken.groupBy("mix_id", "source", "shard").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used"))
    # every shard of the source may take more, one without a quota too
    sums = quotas.select(columns).join(used, ["mix_id", "source", "shard"], "left").withColumn("used", F.coalesce("used", F.lit(0).cast("bigint")))
    of = Window.partitionBy("mix_id", "source")
    room = F.col("max_repeats") * F.col("available") - F.col("used")
    sums = sums.withColumn("left", F.sum(F.col("quota") - F.col("used")).over(of)).withColumn("room", room)
    before = F.coalesce(F.sum("room").over(of.orderBy(F.desc("room"), "shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    again = sums.withColumn("more", F.least("room", F.col("left") - before)).filter("more > 0").withColumn("quota", F.col("used") + F.col("more")).select(columns)
    last = work_path(spark, "receivers")
    again.write.parquet(last)
    again = spark.read.parquet(last)
    kept = taken.join(small_side(again.select("mix_id", "source", "shard")), ["mix_id", "source", "shard"], "left_anti")
    return kept.select(out).unionByName(chosen(again).select(out)), quotas


def _select(pdf):
    """Documents of one shard: whole rounds first, then each in seeded order that still fits."""
    pdf = pdf.sort_values(["turn", "doc_id", "copy_of"], kind="stable")
    quota, available, most = int(pdf["quota"].iat[0]), int(pdf["available"].iat[0]), int(pdf["max_repeats"].iat[0])
    rounds = min(int(quota // available), most)
    rest = quota - rounds * available
    copies = []
    for n in pdf["tokens"].tolist():
        more = rounds < most and n <= rest
        rest -= n if more else 0
        copies.append(rounds + more)
    out = pdf[["mix_id", "source", "shard", "doc_id", "tokens"]].assign(copies=copies)
    return out[out["copies"] > 0]


def share_report(chosen: DataFrame, quotas: DataFrame) -> DataFrame:
    """mix_id, source, target_share, share, tokens_available, tokens, documents, most_copies, max_repeats, blocks."""
    used = chosen.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    of = quotas.groupBy("mix_id", "source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"), F.sum("available").alias("tokens_available"), F.sum("blocks").alias("blocks"))
    whole = Window.partitionBy("mix_id")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return of.join(used, ["mix_id", "source"], "left").select(
        "mix_id", "source", "target_share", "max_repeats", "tokens_available", "blocks", zero("tokens"), zero("documents"), zero("most_copies"),
    ).withColumn("share", F.coalesce(F.try_divide(F.col("tokens").cast("double"), F.sum("tokens").over(whole).cast("double")), F.lit(0.0)))
