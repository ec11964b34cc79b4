"""Readers and writers: declared schemas, additive evolution, upserts by partition."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, LongType, StringType, StructField, StructType

from tessera.operators.joins import keep_last

#: Daily bars as stored.
BARS = StructType(
    [StructField("symbol", StringType()), StructField("date", DateType())]
    + [StructField(c, DoubleType()) for c in ("open", "high", "low", "close", "volume", "amount")]
    + [StructField("quote_ts", LongType())]
)


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """Bars under the declared schema: missing columns are null, further ones are left out, filters on date prune partitions."""
    return spark.read.schema(BARS).parquet(path)


#: Encodings that Spark reads without being told that others are allowed, and those that are tried on a file, in this order.
OWN_ENCODINGS = ("UTF-8", "US-ASCII", "ISO-8859-1", "UTF-16", "UTF-16BE", "UTF-16LE", "UTF-32")
TRIED = ("utf-8", "gb18030", "iso-8859-1")
SAMPLE = 65_536


def encoding_of(spark: SparkSession, path: str) -> str:
    """The first of TRIED in which the first bytes of the first file make sense."""
    head = spark.read.format("binaryFile").load(path).select("path", F.substring("content", 1, SAMPLE).alias("head")).agg(F.min_by("head", "path").alias("head")).first()["head"]
    for name in TRIED:
        try:
            bytes(head or b"").decode(name)
        except UnicodeDecodeError as e:
            if e.start < len(head) - 4:  # not just a character that the sample cut
                continue
        return name.upper()
    return TRIED[-1].upper()


def read_csv(spark: SparkSession, path: str, schema: StructType, encoding: str | None = None) -> DataFrame:
    """A CSV with a header; without an encoding given, it is guessed from the first file."""
    encoding = encoding or encoding_of(spark, path)
    if encoding.upper() not in OWN_ENCODINGS:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    return spark.read.schema(schema).option("header", True).option("encoding", encoding).csv(path)


def read_json(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def from_json_paths(rows: DataFrame, column: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """Columns from dot paths of a JSON text: name to (path, type); what can't be cast is null."""
    return rows.select("*", *[F.get_json_object(column, f"$.{path}").try_cast(kind).alias(name) for name, (path, kind) in fields.items()])


def unified(frames: dict[str, DataFrame], kind: str = "asset_type") -> DataFrame:
    """Tables by name, under one another, with the name as a column; columns that one lacks are null."""
    out = None
    for name, df in frames.items():
        one = df.withColumn(kind, F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def existing(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at a path; None where there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def rewritten(spark: SparkSession, path: str, rows: DataFrame, partition: str, aside: bool = True) -> None:
    """Replace the partitions of a table that ``rows`` has.

    Rows are written beside the table first, under a name of this run, since Spark can't
    overwrite what it reads (aside false: they do not read it); then one job overwrites the partitions. Rows of a partition are
    brought together first, and a large one split by its size, so that files are few. The
    rows beside it are deleted once the table has them.
    """
    beside = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    if aside:
        rows.write.parquet(beside)
        rows = spark.read.schema(rows.schema).parquet(beside)
    rows.hint("rebalance", partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    if not aside:
        return
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(beside)  # the store's own interface, as the path may be on any
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def touched(old: DataFrame, rows: DataFrame, partition: str) -> DataFrame:
    """What ``old`` has in the partitions of ``rows``; the others are not read. The driver holds a value a partition."""
    return old.where(F.col(partition).isin([r[0] for r in rows.select(partition).distinct().collect()]))


def upsert(spark: SparkSession, path: str, rows: DataFrame, key: list[str], partition: str, order: str) -> None:
    """Merge ``rows`` into a partitioned table, the last by ``order`` of each key staying; only their partitions are written again."""
    old = existing(spark, path)
    if old is not None:
        rows = touched(old, rows, partition).unionByName(rows, allowMissingColumns=True)
    rewritten(spark, path, keep_last(rows, key, [order]), partition)


def replace_days(spark: SparkSession, path: str, rows: DataFrame, key: list[str], partition: str) -> None:
    """Whole (partition, kind, ...) days give way to ``rows``; what the partition holds of other kinds stays."""
    old = existing(spark, path)
    if old is not None:
        kept = touched(old, rows, partition).join(rows.select(*key).distinct(), key, "left_anti")
        rows = kept.unionByName(rows, allowMissingColumns=True)
    rewritten(spark, path, rows, partition)


def append_new(spark: SparkSession, path: str, rows: DataFrame, key: list[str], order: str) -> None:
    """Append the rows whose key the table lacks, the first of each by ``order``; nothing that is there is written again."""
    first = rows.groupBy(*key).agg(F.min_by(F.struct(*rows.columns), order).alias("r")).select("r.*")
    old = existing(spark, path)
    (first if old is None else first.join(old.select(*key).distinct(), key, "left_anti")).write.mode("append").parquet(path)


def export(spark: SparkSession, rows: DataFrame, path: str, order: list[str]) -> DataFrame:
    """Write ``rows`` as Parquet and as compressed CSV under a path; returns the manifest (format, rows, digest).

    The digest is a sum of hashes of rows, so it does not depend on their order or their files.
    """
    rows.write.mode("overwrite").parquet(f"{path}/parquet")
    back = spark.read.parquet(f"{path}/parquet")
    back.sortWithinPartitions(*order).write.mode("overwrite").option("header", True).option("compression", "gzip").csv(f"{path}/csv")
    csv = spark.read.schema(back.schema).option("header", True).csv(f"{path}/csv")
    digest = F.sum(F.xxhash64(*[F.col(c).cast("string") for c in rows.columns]).cast("decimal(38,0)")).cast("string")
    out = None
    for name, df in (("parquet", back), ("csv", csv)):
        one = df.agg(F.lit(name).alias("format"), F.count("*").alias("rows"), digest.alias("digest"))
        out = one if out is None else out.union(one)
    out.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return spark.read.json(f"{path}/manifest")


#: Conversions that a stored mapping of fields may name; a fixed list, so that no text becomes code.
CONVERSIONS = {
    "text": lambda x: x.cast("string"),
    "number": lambda x: F.regexp_replace(x, ",", "").try_cast("double"),
    "whole": lambda x: F.regexp_replace(x, ",", "").try_cast("bigint"),
    "percent": lambda x: F.regexp_replace(x, "[%,]", "").try_cast("double") / 100,
    "date": lambda x: F.coalesce(F.try_to_timestamp(x, F.lit("yyyy-MM-dd")), F.try_to_timestamp(x, F.lit("yyyyMMdd"))).cast("date"),
    "upper": F.upper,
    "trim": F.trim,
}


def mapped(rows: DataFrame, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """Columns by name from (source column, conversion); what can't be converted is null, an unknown conversion an error."""
    unknown = {how for _, how in fields.values()} - set(CONVERSIONS)
    if unknown:
        raise ValueError(f"unknown conversions {sorted(unknown)}")
    made: list[Column] = [CONVERSIONS[how](F.col(source)).alias(name) for name, (source, how) in fields.items()]
    return rows.select(*made)


def view(spark: SparkSession, name: str, paths: list[str]) -> None:
    """A temporary view over files whose columns may differ: columns that one lacks are null."""
    spark.read.option("mergeSchema", True).parquet(*paths).createOrReplaceTempView(name)


def coverage(rows: DataFrame, time: str, key: str) -> DataFrame:
    """First and last time, rows and keys."""
    return rows.agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("rows"), F.countDistinct(key).alias("keys"))


def lagging(rows: DataFrame, time: str, key: str) -> DataFrame:
    """Keys whose last time is before the table's."""
    last = rows.groupBy(key).agg(F.max(time).alias("last"))
    newest = last.agg(F.max("last").alias("newest"))
    return last.crossJoin(F.broadcast(newest)).where("last < newest").select(key, "last")  # one row on the right
