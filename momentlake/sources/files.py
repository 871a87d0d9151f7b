"""Readers and writers. Every reader gives DataFrames through Spark's sources, so paths may lie in any store Spark reads."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.links import chunk_start
from ..functions.text import caption_time
from ..operators.intervals import words_text

WORD = "struct<text:string,start:double,end:double,confidence:double,speaker:string,language:string,uncertain:boolean>"
TRANSCRIPT = f"source_id string, text string, source_seconds double, words array<{WORD}>"
MOMENT = "struct<start:double,end:double,score:double,topic:string,reason:string>"
GOLD = "struct<gold_start:double,gold_end:double,event_type:string,why_it_is_good:string,required_context:string,payoff_timestamp:double>"


def _name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def transcript_words(transcripts: DataFrame) -> DataFrame:
    """Rows of transcripts (source_id, words) as words; sources without words give none (see empty_transcripts)."""
    w = transcripts.select("source_id", F.posexplode("words").alias("word_idx", "w"))
    return w.select("source_id", F.col("word_idx").cast("long").alias("word_idx"), "w.*").withColumn("uncertain", F.coalesce("uncertain", F.lit(False)))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per file: {text, words, source_seconds?}; source_id is the file's name unless the document has one."""
    raw = spark.read.schema(TRANSCRIPT).json(path, multiLine=True)
    return raw.withColumn("source_id", F.coalesce("source_id", _name(F.input_file_name())))


def empty_transcripts(transcripts: DataFrame) -> DataFrame:
    return transcripts.where(F.col("words").isNull() | (F.size("words") == 0)).select("source_id")


def _rows(spark: SparkSession, path: str, key: str, item: str, lines: bool = False) -> DataFrame:
    """Items of files that hold either a bare list or an object with the list under `key`; source_id is the file's name unless the object has one.

    A file is one document, or with `lines` one a line, so that the documents of many sources need few files.
    """
    text = spark.read.text(path, wholetext=not lines).select(_name(F.input_file_name()).alias("name"), "value")
    bare, wrapped = F.from_json("value", f"array<{item}>"), F.from_json("value", f"struct<source_id:string,{key}:array<{item}>>")
    items = F.when(F.ltrim("value").startswith("["), bare).otherwise(wrapped[key])
    return text.select(F.coalesce(wrapped["source_id"], F.col("name")).alias("source_id"), F.posexplode(items).alias("item_id", "i")).select("source_id", F.col("item_id").cast("long").alias("item_id"), "i.*")


def read_gold(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return _rows(spark, path, "moments", GOLD, lines)


def read_predictions(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return _rows(spark, path, "candidates", MOMENT, lines)


def read_moments(spark: SparkSession, path: str, words: DataFrame, lines: bool = False) -> DataFrame:
    """A moment checkpoint: candidates with their text rebuilt from the words in [start, end)."""
    found = _rows(spark, path, "moments", MOMENT, lines).withColumnRenamed("item_id", "candidate_id")
    return words_text(found, words, ["candidate_id"])


PHRASES = "struct<phrases:array<struct<text:string,speaker:string,locale:string,confidence:double,words:array<struct<text:string,offsetMilliseconds:double,durationMilliseconds:double,confidence:double>>>>,combinedPhrases:array<struct<text:string>>>"


def phrase_words(responses: DataFrame, response: str = "response") -> DataFrame:
    """Words of phrase-style ASR responses (source_id, index): times in seconds of the chunk; a phrase's confidence stands in for missing ones."""
    parsed = responses.select("source_id", "index", F.explode(F.from_json(response, PHRASES)["phrases"]).alias("p"))
    w = parsed.select("source_id", "index", "p", F.explode("p.words").alias("w"))
    start = F.col("w.offsetMilliseconds") / 1000
    return w.select("source_id", "index", F.col("w.text").alias("text"), start.alias("start"), (start + F.col("w.durationMilliseconds") / 1000).alias("end"), F.coalesce("w.confidence", "p.confidence").alias("confidence"), F.col("p.speaker").alias("speaker"), F.col("p.locale").alias("language"), F.lit(False).alias("uncertain"))


def phrase_errors(responses: DataFrame, response: str = "response") -> DataFrame:
    """responses with error: no phrase list, speech without word times, or text without words; null for good ones."""
    p = F.from_json(response, PHRASES)
    untimed = F.exists(p["phrases"], lambda x: (F.trim(F.coalesce(x["text"], F.lit(""))) != "") & (F.coalesce(F.size(x["words"]), F.lit(0)) <= 0))
    words = F.aggregate(p["phrases"], F.lit(0), lambda a, x: a + F.greatest(F.coalesce(F.size(x["words"]), F.lit(0)), F.lit(0)))
    text = F.exists(F.coalesce(p["combinedPhrases"], F.array().cast("array<struct<text:string>>")), lambda x: F.trim(F.coalesce(x["text"], F.lit(""))) != "")
    return responses.withColumn("error", F.when(p.isNull() | p["phrases"].isNull(), "no phrase list").when(untimed, "speech without word times").when((words == 0) & text, "text without words"))


FLAT = "struct<text:string,language:string,words:array<struct<word:string,text:string,start:double,end:double,confidence:double,speaker_id:string,speaker:string>>>"


def flat_words(responses: DataFrame, response: str = "response") -> DataFrame:
    """Words of word-style ASR responses; blank ones go, confidences outside 0 to 1 become null."""
    parsed = responses.select("source_id", "index", F.from_json(response, FLAT).alias("r"))
    w = parsed.select("source_id", "index", F.col("r.language").alias("language"), F.explode("r.words").alias("w"))
    text = F.trim(F.coalesce("w.word", "w.text", F.lit("")))
    confidence = F.when(F.col("w.confidence").between(0, 1), F.col("w.confidence"))
    return w.where(text != "").select("source_id", "index", text.alias("text"), "w.start", "w.end", confidence.alias("confidence"), F.coalesce("w.speaker_id", "w.speaker").alias("speaker"), "language", F.lit(False).alias("uncertain"))


def read_job_logs(spark: SparkSession, path: str) -> DataFrame:
    """Lines of log files as events: job_id from the file's name, event_id in file order."""
    lines = spark.read.text(path).select(_name(F.input_file_name()).alias("job_id"), F.monotonically_increasing_id().alias("event_id"), F.col("value").alias("line"))
    return lines


def read_table(spark: SparkSession, path: str, format: str = "parquet", **options) -> DataFrame:  # noqa: A002
    """A ledger, job or clip table: Parquet by default, or any Spark format such as jdbc with its options."""
    reader = spark.read.format(format).options(**options)
    return reader.load(path) if path else reader.load()


def list_artifacts(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, mtime and length of files under a folder, without their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("modificationTime").alias("mtime"), "length")


def with_chunk_start(files: DataFrame, path: str = "path") -> DataFrame:
    return files.withColumn("chunk_start", chunk_start(F.col(path)))


POINTER, KEPT_VERSIONS = "_current", 2


def replace_table(df: DataFrame, path: str, format: str = "parquet", keep: int = KEPT_VERSIONS) -> None:  # noqa: A002
    """Replace what stands at path for all readers at once (read_replaced): a version of its own is written whole, then a pointer to it is moved in place.

    A reader sees the old version or the new one, never a mixture or nothing, and a write that fails leaves the old one. The newest
    `keep` versions stay, so that a reader that began on the one before can end. Writers must not run at the same time.
    """
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()  # noqa: SLF001
    at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    fs = at("x").getFileSystem(conf)
    versions = sorted(f.getPath().getName() for f in fs.listStatus(jvm.org.apache.hadoop.fs.Path(path)) if f.isDirectory() and f.getPath().getName().startswith("v-")) if fs.exists(jvm.org.apache.hadoop.fs.Path(path)) else []
    name = f"v-{int(versions[-1].split('-')[1]) + 1 if versions else 0:012d}-{uuid.uuid4().hex[:8]}"
    df.write.format(format).save(f"{path}/{name}")
    staged = at(f".{POINTER}-{uuid.uuid4().hex}")
    out = fs.create(staged, True)
    out.write(f"{name} {format}".encode())
    out.close()
    overwrite = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)  # noqa: SLF001
    overwrite[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    qualified = fs.makeQualified(staged)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified.toUri(), conf).rename(qualified, fs.makeQualified(at(POINTER)), overwrite)
    for old in [*versions, name][: -max(1, keep)]:
        fs.delete(at(old), True)


def read_replaced(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """What replace_table has put at path, as it stands now; later replacements don't change a DataFrame made before."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()  # noqa: SLF001
    pointer = jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}")
    stream = pointer.getFileSystem(conf).open(pointer)
    name, kind = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split(" ")
    stream.close()
    reader = spark.read.format(kind)
    return (reader.schema(schema) if schema else reader).load(f"{path}/{name}")


def write_candidates(df: DataFrame, path: str, format: str = "json") -> None:  # noqa: A002
    """Replace a folder of candidates, timings or scores for all its readers at once; see replace_table and read_replaced."""
    replace_table(df, path, format)


def write_scout_audit(candidates: DataFrame, path: str, threshold: float = 36.0) -> None:
    """All candidates in one table, partitioned by whether they were selected."""
    candidates.withColumn("selected", F.col("preliminary_score") >= threshold).write.mode("overwrite").partitionBy("selected").parquet(path)


def write_named(rows: DataFrame, folder: str) -> int:
    """A file per row (name, value) under folder, a path or URI that all executors reach; how many there are.

    Tasks write and rename their own files, so none passes the driver, and one that runs again replaces its own. Spark's writer would
    start a process or two per file on a local disk. Runs when it is called.
    """
    uri = f"file://{folder.removeprefix('file:')}" if folder.startswith("file:/") and not folder.startswith("file://") else folder

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = arrow_fs.FileSystem.from_uri(uri)
        store.create_dir(base, recursive=True)
        for pdf in parts:
            for name, value in zip(pdf["name"], pdf["value"], strict=True):
                staged = f"{base}/.{name}-{uuid.uuid4().hex}"
                with store.open_output_stream(staged) as out:
                    out.write(value.encode())
                store.move(staged, f"{base}/{name}")
            yield pd.DataFrame({"n": [len(pdf)]})

    return rows.select("name", "value").mapInPandas(run, "n long").groupBy().sum("n").first()[0] or 0


def dialogue_lines(captions: DataFrame, text: str = "text") -> DataFrame:
    """(source_id, clip_id, line, value): caption lines as subtitle dialogue."""
    return captions.select("source_id", "clip_id", "line", F.concat(F.lit("Dialogue: 0,"), caption_time(F.col("rel_start")), F.lit(","), caption_time(F.col("rel_end")), F.lit(",Default,"), F.col(text)).alias("value"))


def posts_text(posts: DataFrame) -> DataFrame:
    """(clip_id, value): the sections of a clip's posts as one text."""
    part = lambda title, c: F.concat(F.lit(f"=== {title} ===\n"), F.coalesce(c, F.lit("")))
    return posts.select("clip_id", F.concat_ws("\n\n", part("YOUTUBE", F.col("youtube_title")), part("TIKTOK", F.col("tiktok_title")), part("X", F.col("x_post"))).alias("value"))


def write_lines(lines: DataFrame, path: str, by: str = "clip_id") -> None:
    """A text folder per clip, lines in order."""
    order = [c for c in ("line",) if c in lines.columns]
    lines.repartition(by).sortWithinPartitions(by, *order).select(by, "value").write.mode("overwrite").partitionBy(by).text(path)
