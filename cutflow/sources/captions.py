"""Caption readers: whole SRT, WebVTT and transcript files in, one row a cue out."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

SRT = r"(?s)(\d+)\s*\n(\d{2}:\d{2}:\d{2},\d{3})\s*-->\s*(\d{2}:\d{2}:\d{2},\d{3})\s*\n(.*?)(?=\n\s*\n|\n?\z)"
VTT = r"(?s)(\d{2}:\d{2}:\d{2}\.\d{3})\s*-->\s*(\d{2}:\d{2}:\d{2}\.\d{3})[^\n]*\n(.*?)(?=\n\s*\n|\n?\z)"
WHISPER = "struct<segments:array<struct<start:double,end:double,text:string,words:array<struct<word:string,start:double,end:double>>>>>"


def seconds(stamp: Column) -> Column:
    """Seconds of HH:MM:SS,mmm or HH:MM:SS.mmm."""
    p = F.split(stamp, r"[:,.]")
    return p[0].cast("double") * 3600 + p[1].cast("double") * 60 + p[2].cast("double") + p[3].cast("double") / 1000


def parse_srt(files: DataFrame, text: str) -> DataFrame:
    """files with SRT text -> their other columns, n, a, b, text; line breaks inside a cue become spaces."""
    cue = lambda g: F.regexp_extract_all(text, F.lit(SRT), F.lit(g))
    rest = [c for c in files.columns if c != text]
    rows = files.select(*rest, F.explode_outer(F.arrays_zip(cue(1).alias("n"), cue(2).alias("a"), cue(3).alias("b"), cue(4).alias("text"))).alias("c")).where("c is not null")
    return rows.select(*rest, F.col("c.n").cast("bigint").alias("n"), seconds(F.col("c.a")).alias("a"), seconds(F.col("c.b")).alias("b"), F.trim(F.replace(F.col("c.text"), F.lit("\n"), F.lit(" "))).alias("text"))


def parse_vtt(files: DataFrame, text: str) -> DataFrame:
    """files with WebVTT text -> their other columns, a, b, text."""
    cue = lambda g: F.regexp_extract_all(text, F.lit(VTT), F.lit(g))
    rest = [c for c in files.columns if c != text]
    rows = files.select(*rest, F.explode_outer(F.arrays_zip(cue(1).alias("a"), cue(2).alias("b"), cue(3).alias("text"))).alias("c")).where("c is not null")
    return rows.select(*rest, seconds(F.col("c.a")).alias("a"), seconds(F.col("c.b")).alias("b"), F.trim(F.replace(F.col("c.text"), F.lit("\n"), F.lit(" "))).alias("text"))


def parse_transcript(files: DataFrame, text: str) -> DataFrame:
    """files with transcript JSON -> their other columns, a, b, text, words; malformed JSON gives no rows."""
    rest = [c for c in files.columns if c != text]
    rows = files.select(*rest, F.explode_outer(F.from_json(text, WHISPER)["segments"]).alias("s")).where("s is not null")
    return rows.select(*rest, F.col("s.start").alias("a"), F.col("s.end").alias("b"), F.trim("s.text").alias("text"), F.col("s.words").alias("words"))


def load_captions(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Caption files by their suffix (.srt, .vtt, .json), or of the kind given -> file, a, b, text."""
    for suffix, parse in ((".srt", parse_srt), (".vtt", parse_vtt), (".json", parse_transcript)):
        if (f".{kind}" if kind else path.lower()).endswith(suffix):
            files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value"))
            return parse(files, "value").select("file", "a", "b", "text")
    raise ValueError(f"no caption format: {path}")


def load_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Files with a transcript's JSON on each line -> a, b, text."""
    return parse_transcript(spark.read.text(path), "value").select("a", "b", "text")
