"""Far too many small files: tiny parts are consolidated into few of good size.

The listing says which level-0 parts are still to be consolidated. Their rows are
shuffled under a REBALANCE hint, so that runtime statistics merge and split the output
partitions near the target size, also where one index holds most rows. The commit is
made only if rows read and rows written agree in a multiset checksum; its manifest
names every input part and every part written.

Defined results:
- a part listed several times counts as its last listing says;
- null event_count of a merged part, or of one of its inputs, or an input that isn't listed: not complete;
- inputs that are null or blank: no inputs; spelled as JSON, comma or semicolon lists, with or without directory and suffix;
- levels only tell merged parts (1 or more) from tiny ones (0), a null level is neither; links in a circle end;
- an empty table gives an empty manifest; columns of any name pass through unchanged;
- rows that are equal in all columns are all kept (the checksum counts them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.plans.shared import free_name, remove_path, small_side, with_conf, work_path

TARGET_BYTES = 64 << 20


def last_listing(parts: DataFrame) -> DataFrame:
    kept = F.max_by(
        F.struct("level", "event_count", "removed_at", "inputs", "index_name", "size_bytes"),
        F.struct("listed_at", F.col("removed_at").isNotNull(), F.col("event_count")),
    )
    return parts.filter("part_id is not null").groupBy("part_id").agg(kept.alias("p")).select("part_id", "p.*")


def input_ids(inputs: Column) -> Column:
    """The ids in an inputs text, each once."""
    words = F.split(inputs, r"[\[\]{}\"',;|\s]+")
    bare = F.transform(words, lambda w: F.regexp_replace(F.regexp_replace(w, r"^.*/", ""), r"\.[a-z]+$", ""))
    return F.array_distinct(F.filter(bare, lambda w: w != ""))


def merge_links(listed: DataFrame) -> DataFrame:
    """(parent, child, alive): the inputs of complete merged parts."""
    edges = listed.filter("level >= 1").select(
        F.col("part_id").alias("parent"), "event_count", F.col("removed_at").isNull().alias("alive"), F.explode(input_ids(F.col("inputs"))).alias("child")
    )
    counted = edges.join(listed.select(F.col("part_id").alias("child"), F.col("event_count").alias("held")), "child", "left")
    complete = (
        counted.groupBy("parent", "event_count")
        .agg(F.sum("held").alias("total"), F.sum(F.col("held").isNull().cast("int")).alias("unknown"))
        .filter("total = event_count and unknown = 0")
        .select("parent")
    )
    return counted.join(complete, "parent", "left_semi").select("parent", "child", "alive")


def written_once(spark: SparkSession, df: DataFrame, at: str) -> DataFrame:
    df.write.parquet(at)
    return spark.read.parquet(at)


def covered_parts(spark: SparkSession, listed: DataFrame, at: str) -> DataFrame:
    """(part_id, root): parts that a complete, living merged part holds, directly or through complete ones.

    A fixed point: each step follows the links of the parts that the step before reached
    first, and the last step reaches none. Levels aren't read, and links in a circle end.
    """
    links = written_once(spark, merge_links(listed), f"{at}/links")
    first = links.filter("alive").groupBy(F.col("child").alias("part_id")).agg(F.max("parent").alias("root"))
    front = written_once(spark, first, f"{at}/reached0")
    found, k = front, 0
    while not front.isEmpty():
        k += 1
        onward = front.join(links, front["part_id"] == links["parent"]).groupBy(F.col("child").alias("part_id")).agg(F.max("root").alias("root"))
        front = written_once(spark, onward.join(found, "part_id", "left_anti"), f"{at}/reached{k}")
        found = spark.read.parquet(*(f"{at}/reached{i}" for i in range(k + 1)))
    return found


def pending_parts(spark: SparkSession, parts: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """(level-0 parts that are neither removed nor held by a living, complete merged part, covered parts); both written at at."""
    listed = written_once(spark, last_listing(parts), f"{at}/listed")
    covered = covered_parts(spark, listed, at)
    pending = listed.filter("level = 0 and removed_at is null").join(covered, "part_id", "left_anti")
    return written_once(spark, pending.select("part_id", "event_count", F.coalesce("index_name", F.lit("main")).alias("index_name")), f"{at}/pending"), covered


def checksum(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: number of rows and the sum of two hashes of each; equal for equal multisets of rows."""
    texts = [F.to_json(F.col(f"`{c}`")) if t.startswith(("array", "map", "struct", "variant")) else F.col(f"`{c}`") for c, t in df.select(*(f"`{c}`" for c in columns)).dtypes]
    wide = lambda h: F.sum(h.cast("decimal(38,0)"))
    return df.agg(
        F.count("*").alias("rows"),
        wide(F.xxhash64(F.lit(1), *texts)).alias("one"),
        wide(F.xxhash64(F.lit(2), *texts, F.hash(*texts))).alias("two"),
    )


def consolidate(spark: SparkSession, rows: DataFrame, parts: DataFrame, target_bytes: int = TARGET_BYTES) -> tuple[DataFrame, DataFrame, str]:
    """Rewrite the rows of pending parts. Returns (input parts of the commit, parts written, path).

    rows has part_id and index_name. Rows of several indexes are not mixed in a file; those
    of one input part may lie in several where its index is larger than target_bytes. The
    inputs of the commit are the parts whose rows were written, and the pending ones that
    have none.
    """
    at = work_path(spark, "compact", keep=True)
    pending, _ = pending_parts(spark, parts, f"{at}/listing")
    return _rewrite(spark, rows, pending, at, target_bytes)


def _rewrite(spark: SparkSession, rows: DataFrame, pending: DataFrame, at: str, target_bytes: int) -> tuple[DataFrame, DataFrame, str]:
    marker = free_name(rows, "to_index")
    wanted = small_side(pending.select("part_id"))
    chosen = rows.join(wanted, "part_id", "left_semi").select(*(F.col(f"`{c}`") for c in rows.columns))
    moved = chosen.withColumn(marker, F.coalesce("index_name", F.lit("main"))).hint("rebalance", marker)
    with with_conf(spark, {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_bytes),
        "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }):
        moved.write.partitionBy(marker).parquet(f"{at}/staged")
    written = spark.read.parquet(f"{at}/staged") if _any_file(spark, f"{at}/staged") else spark.createDataFrame([], moved.schema)
    before, after = (checksum(x, rows.columns).first() for x in (chosen, written))
    if before != after:
        remove_path(spark, at)
        raise RuntimeError(f"rows read and rows written differ, nothing is committed: {before} and {after}")
    moved_rows = written.groupBy("part_id").agg(F.count("*").alias("rows_written"))
    empty = pending.join(rows.select("part_id").distinct(), "part_id", "left_anti").select("part_id", F.lit(0).cast("bigint").alias("rows_written"))
    inputs = moved_rows.unionByName(empty).join(pending, "part_id").select("part_id", "event_count", "index_name", "rows_written")
    inputs.write.parquet(f"{at}/commit/inputs")
    if written.inputFiles():
        outputs = written.groupBy(F.col("_metadata.file_path").alias("path"), F.col(marker).alias("index_name")).agg(
            F.count("*").alias("event_count"), F.max("_metadata.file_size").alias("size_bytes")
        )
    else:
        outputs = spark.createDataFrame([], "path string, index_name string, event_count bigint, size_bytes bigint")
    outputs.write.parquet(f"{at}/commit/outputs")  # the new parts and their manifest stay
    return spark.read.parquet(f"{at}/commit/inputs"), spark.read.parquet(f"{at}/commit/outputs"), at


def _any_file(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(p, True)
    while files.hasNext():
        if files.next().getPath().getName().endswith(".parquet"):
            return True
    return False


def part_layout(spark: SparkSession, rows: DataFrame, parts: DataFrame, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """part, event_count, rewritten: every row of rows in exactly one part: a new one, or the merged part that already holds it.

    Rows whose level-0 part was removed without a merged part that holds them stay in it.
    """
    at = work_path(spark, "compact", keep=True)
    pending, covered = pending_parts(spark, parts, f"{at}/listing")
    _, outputs, _ = _rewrite(spark, rows, pending, at, target_bytes)
    kept = rows.groupBy("part_id").agg(F.count("*").alias("n")).join(pending.select("part_id"), "part_id", "left_anti").join(covered, "part_id", "left")
    carried = kept.groupBy(F.coalesce("root", "part_id").alias("part")).agg(F.sum("n").alias("event_count"), F.lit(False).alias("rewritten"))
    return outputs.select(F.regexp_extract("path", r"([^/]+)\.parquet$", 1).alias("part"), "event_count", F.lit(True).alias("rewritten")).unionByName(carried)
