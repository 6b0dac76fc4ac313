"""What the operators share: tables, the shared folder, written intermediate tables."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD_GAP = r"[\x20\x09-\x0D]+"
GAP_CHARS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; one of our own only where it is unset and all run here."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="gleanbin-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/gleanbin/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder, reread: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes written tables that nothing reads any more."""
    jvm = spark._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def give_back() -> None:
    """Returns freed memory of a Python worker to the system, as workers stay for later stages."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def words(text: Column) -> Column:
    """The words of a text as an array; empty for null or blank texts."""
    return F.when(F.coalesce(F.btrim(text, F.lit(GAP_CHARS)), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(F.btrim(text, F.lit(GAP_CHARS)), WORD_GAP))


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row: bound to the lambda variable of a one-element transform."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shielded(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns named by position (_k0, _k1, ...), and those names by the old: none can clash with ours."""
    return df.toDF(*[f"_k{k}" for k in range(len(df.columns))]), {c: f"_k{k}" for k, c in enumerate(df.columns)}


def restored(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns of a shielded table, under their own names."""
    return df.select(*[F.col(k).alias(c) for c, k in names.items()])


class Scratch:
    """Written tables that go together."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, tag: str) -> DataFrame:
        df, path = written(df, tag)
        self.paths.append(path)
        return df

    def clear(self) -> None:
        discard(self.spark, *self.paths)
        self.paths = []


#: Bits of the filter that among() sends to all workers: 8 MB, whatever the number of ids.
FILTER_BITS = 1 << 26


def among(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows of df whose key is in ids (one column of the same name), for few ids against many wide rows.

    A bitmap of the ids' hashes, of fixed size, leaves out most other rows before the rows are shuffled for the exact
    semi-join; where ids are so many that it fills, it only stops helping.
    """
    place = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS)) + 1
    bits = ids.select(place.alias("_p")).groupBy(F.bitmap_bucket_number("_p").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_p")).alias("_bits"))
    at = F.bitmap_bit_position(place)
    hit = F.conv(F.hex(F.substring(F.col("_bits"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    near = df.withColumn("_bucket", F.bitmap_bucket_number(place)).join(F.broadcast(bits), "_bucket")  # FILTER_BITS / 8 bytes at most
    near = near.where(F.lit(1) == F.pmod(F.floor(hit / F.pow(F.lit(2), F.pmod(at, F.lit(8)))), F.lit(2))).drop("_bucket", "_bits")
    return near.join(ids, key, "left_semi")
