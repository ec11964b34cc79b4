"""Written tables that cut lineage, in the folder which the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where it is unset on one machine, as in tests, a new temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    A lost executor then costs the rereading of a file, and joins on the result get
    exchanges of their own, which adaptive execution may split where a key is hot.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: White space of the word definition `[^\x20\x09-\x0D]+`, as a Java character class.
SPACES = "[ \\t-\\r]+"


def words(text: Column) -> Column:
    """The words of a text, in order; none for a null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")
