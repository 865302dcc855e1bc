"""What the corpus operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SLICE, SLICE_BYTES = 256, 16 << 20  # rows and bytes that a Python worker holds as Python objects at once; one row at least


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def dealt_join(rows: DataFrame, other: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join that deals both sides by key, whatever their size.

    Left to itself, Spark broadcasts a side of which the compressed shuffle files are small, and its
    rows come to the driver in four times that memory or more, for every join of a job.
    """
    return rows.join(other.hint("merge"), on, how)


def use_checkpoints(spark: SparkSession) -> None:
    """Points checkpoint() at the folder the cluster names; a temporary one only where none is set on a local master (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not named:
            named = tempfile.mkdtemp(prefix="polystore-ckpt-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and reads it back, so that its lineage ends there."""
    use_checkpoints(df.sparkSession)
    return df.checkpoint()


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


#: A fixed-size filter of 64-bit keys: FILTER_BITS bits, 8 MB, in rows of 4 KB, whatever the number of keys.
FILTER_BITS = 1 << 26


def key_filter(keys: DataFrame) -> DataFrame:
    """The filter of the longs in the column key: (bucket, bits)."""
    spot = F.pmod("key", F.lit(FILTER_BITS))
    return keys.select(F.bitmap_bucket_number(spot).alias("bucket"), F.bitmap_bit_position(spot).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def may_be_in(rows: DataFrame, key: Column, there: DataFrame, name: str) -> DataFrame:
    """rows with the boolean column `name`: whether the key may be in the filter."""
    names = rows.columns
    spot = F.pmod(key, F.lit(FILTER_BITS))
    own = rows.withColumns({"_bucket": F.bitmap_bucket_number(spot), "_bit": F.bitmap_bit_position(spot)})
    met = own.join(F.broadcast(there), F.col("_bucket") == F.col("bucket"), "left")
    byte = F.conv(F.hex(F.substring("bits", (F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return met.select(*names, F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, CAST(_bit % 8 AS INT))")) != 0, F.lit(False)).alias(name))


def maybe_in(rows: DataFrame, key: Column, there: DataFrame) -> DataFrame:
    """Rows whose key may be in the filter: all that are, and few others while the filter isn't full."""
    return may_be_in(rows, key, there, "_may").where("_may").drop("_may")


MANY, SALTS = 1_000, 256  # a text with over so many partners is dealt to so many tasks


def with_texts(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """pairs (a, b, ...) of hashes with text_a and text_b from rows (hash, text).

    A text with over MANY partners is dealt to SALTS tasks, so that no task gets all its pairs;
    texts without a partner stay where they are.
    """
    names = pairs.columns
    ends = pairs.select(F.explode(F.array("a", "b")).alias("key"))
    hot = key_filter(ends.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > MANY).select("key"))
    for side, other in (("a", "b"), ("b", "a")):
        pairs = may_be_in(pairs, F.col(side), hot, "_hot").withColumn(f"salt_{side}", F.when(F.col("_hot"), F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int")).otherwise(0)).drop("_hot")
    pairs = cut(pairs)
    needed = cut(pairs.select(F.col("a").alias("hash"), F.col("salt_a").alias("salt")).union(pairs.select("b", "salt_b")).groupBy("hash").agg(F.collect_set("salt").alias("salts")))
    wanted = key_filter(needed.select(F.col("hash").alias("key")))
    texts = dealt_join(maybe_in(rows, F.col("hash"), wanted), needed, "hash").groupBy("hash").agg(F.first("text").alias("text"), F.first("salts").alias("salts")).select("hash", "text", F.explode("salts").alias("salt"))
    for side in ("b", "a"):
        own = texts.select(F.col("hash").alias(side), F.col("salt").alias(f"salt_{side}"), F.col("text").alias(f"text_{side}"))
        pairs = dealt_join(pairs, own, [side, f"salt_{side}"])
    return pairs.select(*names, "text_a", "text_b")


BLOCK = 512  # rows of a key that meet another block of them in one task


def met_in_blocks(rows: DataFrame, meet: Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray], list[np.ndarray]], schema: str) -> DataFrame:
    """meet(columns, x, y) of all pairs x, y (numbers of rows) of rows that share a key.

    rows have the columns key and hash. A key's rows are dealt to blocks by hash and every two
    blocks are a group, so that no task holds a whole key or all its pairs.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(table: pa.Table) -> pa.Table:
        columns = {n: table.column(n).to_numpy() for n in table.column_names}
        block, low, high = columns["_block"], columns["_low"][0], columns["_high"][0]
        if low == high:
            x, y = np.triu_indices(len(block), 1)
        else:
            x, y = (v.ravel() for v in np.meshgrid(np.flatnonzero(block == low), np.flatnonzero(block == high), indexing="ij"))
        return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(meet(columns, x, y), out, strict=True)], schema=out)

    blocks = rows.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_blocks"))
    own = dealt_join(rows, blocks, "key").withColumn("_block", F.pmod(F.xxhash64("hash"), F.col("_blocks")).cast("int"))
    dealt = own.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    dealt = dealt.select(*rows.columns, "_block", F.least("_block", "_other").alias("_low"), F.greatest("_block", "_other").alias("_high"))
    return dealt.groupBy("key", "_low", "_high").applyInArrow(run, schema)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most SLICE rows and SLICE_BYTES bytes, of one row at least."""
    at = 0
    while at < batch.num_rows:
        part = batch.slice(at, SLICE)
        while part.num_rows > 1 and part.nbytes > SLICE_BYTES:
            part = batch.slice(at, part.num_rows // 2)
        yield part
        at += part.num_rows


def map_rows(df: DataFrame, make: Callable[[], Callable[[list[dict]], list[tuple]]], schema: str) -> DataFrame:
    """df row by row through Python in slices: make() runs once a task and returns the function of a slice.

    The function gets the slice as a list of dicts and returns tuples in the order of schema.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch):
                rows = work(part.to_pylist())
                if rows:
                    columns = [pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, schema=out)

    return df.mapInArrow(run, schema)
