"""Reading text files of mixed encoding.

Exchange downloads and broker statements are one small file per day or account, in UTF-8, GBK or
GB18030: the file is the unit of decoding and section detection (``read_texts``). Large line files
are read in splits instead (``read_lines``). No byte of a longer character is a line end in these
encodings, so Spark's text source may cut them at line ends before anything is decoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Spark 4 limits ``decode`` to a few charsets, and fails a job on a bad byte, unless these are on.
DECODE_SETTINGS = ("spark.sql.legacy.javaCharsets", "spark.sql.legacy.codingErrorAction")


def allow_gb18030(spark: SparkSession) -> None:
    """Turns the switches on where the session does not have them yet (``build_session`` sets them)."""
    for name in DECODE_SETTINGS:
        if spark.conf.get(name, "false") != "true":
            spark.conf.set(name, "true")


def decoded(content: Column) -> Column:
    """Bytes to text: valid UTF-8 as such, everything else as GB18030, which holds all of GBK;
    byte-order mark removed. Bytes that are neither become replacement characters."""
    raw = content.cast("string")
    text = F.when(F.is_valid_utf8(raw), raw).otherwise(F.decode(content, "GB18030"))
    return F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n?", "\n")


def read_all_texts(spark: SparkSession, path: str | list[str], pattern: str | None = None) -> DataFrame:
    """file, text, readable - one row per file below the path; one bad file stops no other."""
    allow_gb18030(spark)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"),
                                    decoded(F.col("content")).alias("text")) \
                 .withColumn("readable", ~F.col("text").contains("\ufffd"))


def read_texts(spark: SparkSession, path: str | list[str], pattern: str | None = None) -> DataFrame:
    """file, text - of every file that can be decoded."""
    return read_all_texts(spark, path, pattern).filter("readable").drop("readable")


def unreadable_files(spark: SparkSession, path: str | list[str], pattern: str | None = None) -> DataFrame:
    """file, error - the error relation: files that are neither UTF-8 nor GB18030."""
    return read_all_texts(spark, path, pattern).filter("not readable") \
        .select("file", F.lit("not UTF-8 or GB18030").alias("error"))


def _raw_lines(spark: SparkSession, path: str | list[str], pattern: str | None) -> DataFrame:
    """path, at (where the line's split begins), raw - every line that is not blank, undecoded."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    lines = reader.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"),
                                     F.col("value").cast("binary").alias("raw"))
    return lines.filter(F.trim(F.regexp_replace(F.col("raw").cast("string"), "^\ufeff", "")) != "")


def _files(lines: DataFrame) -> DataFrame:
    """path, header, utf8, readable - one row per file: its first line, and how it is encoded."""
    raw = F.col("raw").cast("string")
    other = F.decode("raw", "GB18030")
    # Line numbers rise within a split, and splits are told apart by where they begin.
    numbered = lines.withColumn("n", F.monotonically_increasing_id())
    return numbered.groupBy("path").agg(F.min_by("raw", F.struct("at", "n")).alias("header"), F.bool_and(F.is_valid_utf8(raw)).alias("utf8"),
                                     F.bool_and(~other.contains("\ufffd")).alias("gb18030")) \
        .withColumn("readable", F.col("utf8") | F.col("gb18030"))


def _line_text(raw: Column) -> Column:
    text = F.when(F.col("utf8"), raw.cast("string")).otherwise(F.decode(raw, "GB18030"))
    return F.regexp_replace(text, "^\ufeff", "")


def read_lines(spark: SparkSession, path: str | list[str], pattern: str | None = None) -> DataFrame:
    """file, header, line - the lines behind the first one of every readable file, in no order.

    One pass finds each file's header and encoding (a file is UTF-8 as a whole or not at all), one
    reads the lines; both run over splits, so no task holds a file.
    """
    allow_gb18030(spark)
    lines = _raw_lines(spark, path, pattern)
    known = _files(lines).filter("readable").select("path", "header", "utf8")
    both = lines.select("path", "raw").join(known, "path")
    # A line like the header may stand in the data as well: all but one of them are data.
    again = both.filter("raw = header").groupBy("path", "header", "utf8").agg((F.count(F.lit(1)) - 1).cast("int").alias("n")) \
        .select("path", F.explode(F.array_repeat("header", F.col("n"))).alias("raw"), "header", "utf8")
    rows = both.filter("raw <> header").select("path", "raw", "header", "utf8").unionByName(again)
    name = F.url_decode(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\+", "%2B"))
    return rows.select(name.alias("file"), _line_text(F.col("header")).alias("header"), _line_text(F.col("raw")).alias("line"))


def unreadable_line_files(spark: SparkSession, path: str | list[str], pattern: str | None = None) -> DataFrame:
    """file, error - the error relation of ``read_lines``."""
    allow_gb18030(spark)
    return _files(_raw_lines(spark, path, pattern)).filter("not readable") \
        .select(F.element_at(F.split("path", "/"), -1).alias("file"), F.lit("not UTF-8 or GB18030").alias("error"))
