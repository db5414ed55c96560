"""Line-oriented JSON: validated reading, exact writing, staged publishing."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BAD = "_corrupt_record"


def read(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = False) -> DataFrame:
    """Rows of ``schema`` plus ``_corrupt_record``; blank lines are skipped; ``strict`` raises on the first bad line."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    full = T.StructType([*schema.fields, T.StructField(_BAD, T.StringType())])
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(full).option("columnNameOfCorruptRecord", _BAD).json(path)


def read_numbered(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """``(file, line, value, error)``: parsed lines with their 1-based number in their file.

    Lines keep their order inside a file split; numbers are counted per split and
    shifted by the lines of the splits before it, so no file is read by one task.
    """
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("m"), "value")
    w = Window.partitionBy("file", "start").orderBy("m")
    sizes = text.groupBy("file", "start").agg(F.count("*").alias("n"))
    before = sizes.withColumn("shift", F.sum("n").over(Window.partitionBy("file").orderBy("start")) - F.col("n")).drop("n")
    rows = text.withColumn("k", F.row_number().over(w)).join(before, ["file", "start"]).withColumn("line", F.col("k") + F.col("shift")).filter(F.trim("value") != "")
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE"})
    ok = F.try_parse_json("value").isNotNull() & F.col("value").rlike(r"^\s*\{")
    return rows.select("file", "line", F.when(ok, parsed).alias("value"), F.when(~ok, F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(": not a JSON object"))).alias("error"))


def validated(df: DataFrame, checks: list[tuple[Column, str]]) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with ``problems``)."""
    problems = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(why)) for ok, why in checks]))
    marked = df.withColumn("problems", problems)
    return marked.filter(F.size("problems") == 0).drop("problems"), marked.filter(F.size("problems") > 0)


def compact_line(df: DataFrame) -> DataFrame:
    """``value``: one compact JSON object a row, nulls included, non-ASCII kept; doubles print their shortest form."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def write(df: DataFrame, path: str, overwrite: bool = False, by: list[str] | None = None) -> int:
    """Compact lines, partitioned by columns; an existing path is an error unless ``overwrite``.  Rows are counted while they are written."""
    from pyspark.sql import Observation

    seen = Observation(f"rows-{uuid.uuid4().hex}")
    rest = [c for c in df.columns if c not in (by or [])]
    out = df.select(*(by or []), F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("value")).observe(seen, F.count("*").alias("n"))
    out.write.mode("overwrite" if overwrite else "errorifexists").partitionBy(*(by or [])).text(path)
    return int(seen.get["n"])


def publish(df: DataFrame, path: str, **options) -> int:
    """Write beside ``path`` first, then swap by rename, so readers never see half a dataset."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(conf)
    stage, old = f"{path}.stage-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    n = write(df, stage, **options)
    if fs.exists(at(path)):
        fs.rename(at(path), at(old))
    if not fs.rename(at(stage), at(path)):
        raise OSError(f"could not publish {path}")
    fs.delete(at(old), True)
    return n


def archive_then_replace(spark: SparkSession, current: DataFrame, merged: DataFrame, path: str, archive: str) -> tuple[int, int]:
    """Keep the rows that will go at ``archive`` (which must not exist), then publish the merged rows."""
    kept = write(current, archive)
    return kept, publish(merged, path)
