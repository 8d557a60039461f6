"""Shared pieces of the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def split_words(text: Column, separators: str = SPACES) -> Column:
    """Words between runs of `separators`; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def let(value: Column, body) -> Column:
    """Bind `value` once inside one expression, however often `body` uses it."""
    return F.transform(F.array(value), body).getItem(0)


def upto(n: Column) -> Column:
    """0..n-1, empty where n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def reserve(df: DataFrame, *names: str) -> dict[str, str]:
    """Internal column names that clash with none of df's, whatever those are called."""
    taken, out = {c.lower() for c in df.columns}, {}
    for name in names:
        fresh = f"__{name}"
        while fresh.lower() in taken:
            fresh = f"_{fresh}"
        out[name] = fresh
    return out


def one_of_each(df: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each value of the keys: that of the smallest hash of all columns (maps, which have no hash, aside)."""
    own = [F.col(f"`{c}`") for c in df.columns]
    hashed = [F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString()]
    picked = df.groupBy(*(F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys))).agg(F.min_by(F.struct(*own), F.xxhash64(*hashed)).alias("row"))
    return picked.select("row.*")


def smallest(df: DataFrame, hash_column: str, n: int, *ties: str) -> DataFrame:
    """The n rows of smallest 64-bit hash (then ties). Where there are many more rows, those beyond twice the expected cut are left out
    first, so that each task hands on its share of about 2n rows and not n rows of its own."""
    rows = df.count()
    thin = df
    if rows > 4 * n:
        cut = int(-(1 << 63) + (2 * n / rows) * float(1 << 64))
        thin = df.where(F.col(hash_column) <= F.lit(cut).cast("long"))
        if thin.count() < n:
            thin = df
    return thin.orderBy(hash_column, *ties).limit(n)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; one of our own only in a local session that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="quantrel-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        context.setCheckpointDir(f"file://{own}")
    return context.getCheckpointDir()


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/quantrel/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def forget(spark: SparkSession, path: str) -> None:
    """Delete a table that materialise() or a writer made; later readers of it must be done."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def materialise(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """Write df to the shared folder once and read it back: the lineage ends there, and executors may be lost."""
    spark = df.sparkSession
    path = path or new_path(spark, tag)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
