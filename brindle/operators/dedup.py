"""Messages delivered more than once: exactly one delivery of each is kept.

Only identifier, delivery order and file-row position are shuffled. The losing
positions become one bitmap per file and block of rows (a deletion vector), which is
applied while the wide rows are read again, so that payloads are never shuffled.

Defined results:
- a row without an identifier is always kept, whatever its other columns hold;
- null source is a source of its own; null columns elsewhere don't matter;
- a row_id that occurs twice is ordered by file and position, so one copy stays;
- an empty table gives an empty table;
- columns of any other name pass through, helper names are chosen so as not to clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.plans.shared import free_name, work_path

#: Names under which an identifier may stand inside a record (fixed values).
ID_NAMES = ("msg_id", "message_id")
#: Rows of one message from which its group counts as hot, and how many such groups are looked up by broadcast.
HOT_ROWS, HOT_GROUPS = 50_000, 1_000
#: Bytes of deletion vectors up to which they are broadcast; beyond, each reading task loads those of its own file.
VECTOR_BYTES = 32 << 20
#: Rows per bitmap of Spark's bitmap functions (fixed value).
BLOCK = 32_768


def canonical_id(text: Column) -> Column:
    """Letters and digits in lower case, without a URN prefix; null if none are left."""
    bare = F.regexp_replace(F.lower(F.trim(text)), r"^\s*urn:[a-z0-9][a-z0-9-]*:", "")
    return F.nullif(F.regexp_replace(bare, r"[^\p{L}\p{N}]+", ""), F.lit(""))


def _inside_json(text: Column) -> Column:
    return F.coalesce(*(F.get_json_object(text, f"$.{n}") for n in ID_NAMES))


def message_id(msg_id: Column, fields_json: Column, event: Column) -> Column:
    """The identifier: msg_id, else inside fields_json, else inside event."""
    in_fields = F.when(fields_json.rlike("|".join(ID_NAMES)), _inside_json(fields_json))
    pair = rf"(?:^|[\s|,;\[(])(?:{'|'.join(ID_NAMES)})\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s|,;\"'\])]+))"
    groups = F.concat(*(F.regexp_extract(event, pair, i) for i in (1, 2, 3)))
    in_event = F.when(
        event.rlike("|".join(ID_NAMES)),
        F.when(F.ltrim(event).startswith("{"), _inside_json(event)).otherwise(groups),
    )
    return F.coalesce(canonical_id(msg_id), canonical_id(in_fields), canonical_id(in_event))


def locate(df: DataFrame) -> DataFrame:
    """(source, id, row_id, file, pos) of the rows that state an identifier; df must be read from Parquet. A file is known by a number, the hash of its path."""
    return df.select(
        F.coalesce(F.col("source"), F.lit("\0")).alias("source"),
        message_id(F.col("msg_id"), F.col("fields_json"), F.col("event")).alias("id"),
        F.col("row_id"),
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("pos"),
    ).filter("id is not null")


def surplus(located: DataFrame) -> DataFrame:
    """(row_id_a, row_id_b, file, pos) of each delivery that isn't the first of its message.

    The narrow rows are written once, since both sides of the join read them and finding
    identifiers in texts costs more than that.
    Winners are a partial aggregate. The rows of the hottest groups (at most HOT_GROUPS,
    so their broadcast is bounded) find their winner without a shuffle; in the join their
    key is spread over all tasks.
    """
    at = work_path(located.sparkSession, "located")
    located.write.parquet(at)
    located = located.sparkSession.read.parquet(at)
    place = F.struct("row_id", "file", "pos")
    winners = (
        located.groupBy("source", "id").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
    )
    hot = (
        winners.filter(F.col("n") >= HOT_ROWS)
        .orderBy(F.desc("n"), "source", "id")
        .limit(HOT_GROUPS)
        .select("source", "id", F.col("first").alias("hot_first"))
    )
    marked = located.join(F.broadcast(hot), ["source", "id"], "left").withColumn(
        "key", F.when(F.col("hot_first").isNull(), F.col("id")).otherwise(F.concat(F.lit("\0"), F.col("row_id").cast("string")))
    )
    cold = winners.select("source", F.col("id").alias("key"), "first")
    return (
        marked.join(cold, ["source", "key"], "left")
        .withColumn("first", F.coalesce("hot_first", "first"))
        .filter(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(place))
        .select(F.col("first.row_id").alias("row_id_a"), F.col("row_id").alias("row_id_b"), "file", "pos")
    )


def deletion_vectors(lost: DataFrame) -> DataFrame:
    """(file, bucket, bits): one bitmap for each block of a file that loses rows."""
    bit, bucket = F.expr("bitmap_bit_position(pos + 1)"), F.expr("bitmap_bucket_number(pos + 1)")
    return (
        lost.select("file", bucket.alias("bucket"), bit.alias("bit"))
        .groupBy("file", "bucket")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
    )


def duplicate_pairs(df: DataFrame) -> DataFrame:
    """row_id_a, row_id_b: the delivery that is kept and a surplus one."""
    return surplus(locate(df)).select("row_id_a", "row_id_b")


def keep_first_delivery(spark: SparkSession, path: str, vector_bytes: int = VECTOR_BYTES) -> DataFrame:
    """The rows at path, wide, without surplus deliveries."""
    df = spark.read.parquet(path)
    at = work_path(spark, "vectors")
    deletion_vectors(surplus(locate(df))).repartition("file").sortWithinPartitions("file", "bucket").write.parquet(at)
    vectors = spark.read.parquet(at)
    names = {k: free_name(df, k) for k in ("file", "bucket", "bits", "pos")}
    wide = df.select(
        "*",
        F.xxhash64("_metadata.file_path").alias(names["file"]),
        F.col("_metadata.row_index").alias(names["pos"]),
    )
    # every bitmap has BLOCK / 8 bytes, so their number bounds the size
    if vectors.count() * (BLOCK // 8 + 256) <= vector_bytes:
        pos = F.expr(f"bitmap_bit_position(`{names['pos']}` + 1)")
        side = vectors.select(*(F.col(k).alias(names[k]) for k in ("file", "bucket", "bits")))
        byte = F.conv(F.hex(F.expr(f"substring(`{names['bits']}`, cast(bitmap_bit_position(`{names['pos']}` + 1) div 8 + 1 as int), 1)")), 16, 10)
        lost = byte.cast("int").bitwiseAND(F.pow(F.lit(2), pos % 8).cast("int")) != 0
        return (
            wide.withColumn(names["bucket"], F.expr(f"bitmap_bucket_number(`{names['pos']}` + 1)"))
            .join(F.broadcast(side), [names["file"], names["bucket"]], "left")
            .filter(F.col(names["bits"]).isNull() | ~lost)
            .select(*(F.col(f"`{c}`") for c in df.columns))
        )
    return wide.mapInArrow(_apply_from(at, names), df.schema)


def _arrow_uri(at: str) -> str:
    """A path of Hadoop's as Arrow names it."""
    for scheme, name in (("s3a://", "s3://"), ("s3n://", "s3://"), ("dbfs:/", "file:///dbfs/")):
        if at.startswith(scheme):
            return name + at[len(scheme) :]
    return at if ":" in at.split("/")[0] else "file://" + at


def _apply_from(at: str, names: dict[str, str]):
    """Reads, per file, only that file's vectors from the shared folder."""

    def apply(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.dataset as ds
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(_arrow_uri(at))
        stored = ds.dataset(root, filesystem=where, format="parquet")
        known: dict[str, dict[int, np.ndarray]] = {}
        for b in batches:
            files, pos = b.column(names["file"]), b.column(names["pos"]).to_numpy(zero_copy_only=False)
            keep = np.ones(len(pos), bool)
            codes = files.dictionary_encode()
            for k, file in enumerate(codes.dictionary.to_pylist()):
                if file not in known:
                    known.clear()
                    t = stored.to_table(columns=["bucket", "bits"], filter=ds.field("file") == file)
                    known[file] = {
                        n: np.unpackbits(np.frombuffer(x, np.uint8), bitorder="little")
                        for n, x in zip(t["bucket"].to_pylist(), t["bits"].to_pylist())
                    }
                of = codes.indices.to_numpy() == k
                for bucket in np.unique(pos[of] // BLOCK):
                    if (bits := known[file].get(int(bucket) + 1)) is not None:
                        at_ = of & (pos // BLOCK == bucket)
                        keep[at_] = bits[pos[at_] % BLOCK] == 0
            t = pa.Table.from_batches([b]).drop_columns([names["file"], names["pos"]]).filter(pa.array(keep))
            yield from t.combine_chunks().to_batches()

    return apply
