"""Where documents come from, and the folder for tables that jobs write on their way."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import json_field_text


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def version(spark: SparkSession, folder: str, name: str) -> str:
    """A digest of what files a table has, their sizes and times: another one when the table changed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    files, found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True), []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(repr(sorted(found)).encode()).hexdigest()[:16]


def json_documents(spark: SparkSession, path: str, fields: list[str], key: str = "document_id") -> DataFrame:
    """Documents of a file of JSON lines; each line has an id under key, and fields of any depth and type.

    The fields keep their raw JSON until text is taken from them, so lines
    needn't agree on a schema.
    """
    return from_json_strings(spark.read.text(path), "value", fields, F.get_json_object("value", f"$.{key}").cast("long"))


def from_json_strings(rows: DataFrame, column: str, fields: list[str], key) -> DataFrame:
    """(document_id, one text column for each field) of a column of JSON strings."""
    return rows.select(key.alias("document_id"), *(json_field_text(rows[column], f).alias(f) for f in fields))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, set here only where it is unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="inkwell-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: what it took to make it is done once, and isn't lost with an executor."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
