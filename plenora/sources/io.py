"""Declared schemas, coercion, and readers and writers for logs, dimensions and nested documents."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plenora.session import written

RUN_LOG = T.StructType([T.StructField(n, t) for n, t in [("chunk_id", T.StringType()), ("arm", T.StringType()), ("provider", T.StringType()), ("model", T.StringType()), ("speaker_id", T.LongType()), ("session", T.LongType()), ("session_date", T.StringType()), ("knesset", T.IntegerType()), ("duration_s", T.DoubleType()), ("quality", T.DoubleType()), ("reference", T.StringType()), ("hypothesis", T.StringType()), ("latency_s", T.DoubleType()), ("exec_s", T.DoubleType()), ("queue_s", T.DoubleType()), ("language", T.StringType()), ("error", T.StringType()), ("ts", T.TimestampType())]])
SESSION_DOC = "session_id BIGINT, text STRING, segments ARRAY<STRUCT<text: STRING, words: ARRAY<STRUCT<word: STRING, start: DOUBLE, end: DOUBLE, probability: DOUBLE>>>>, map ARRAY<STRUCT<start_char: INT>>, speakers MAP<STRING, STRING>, spk_segments ARRAY<STRUCT<local_speaker_id: BIGINT, start: INT, end: INT>>, meta STRUCT<session_date: STRING, knesset_num: STRING, committee_name: STRING>"
GOLD_DOC = "protocol_sentences ARRAY<STRUCT<sentence_text: STRING, speaker_id: STRING, speaker_name: STRING, is_valid_speaker: BOOLEAN>>"


def coerce(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with exactly the schema's columns in order: missing ones null, values that do not convert null, extra ones dropped.

    An empty input keeps the full schema.
    """
    have = set(df.columns)
    return df.select(*[(F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])


def read_run_log(spark: SparkSession, path: str, skip_prefixes: tuple[str, ...] = ("verify", "e2e")) -> DataFrame:
    """An append-only JSONL log; torn or bad lines are left out, and so are files whose name starts with a prefix."""
    schema = T.StructType([*RUN_LOG.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").json(path).select("*", F.col("_metadata.file_name").alias("__file"))
    ok = rows.filter(F.col("_corrupt_record").isNull())
    for p in skip_prefixes:
        ok = ok.filter(~F.col("__file").startswith(p))
    return ok.drop("_corrupt_record", "__file")


def read_dimension(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV dimension with a header and a declared schema; a byte order mark is dropped; never inferred.
    Columns are taken by their place, so a mark before the first name does no harm."""
    return spark.read.schema(schema).option("header", True).option("encoding", "UTF-8").option("enforceSchema", True).csv(path)


def read_sharded(spark: SparkSession, path: str) -> DataFrame:
    """A folder of parquet shards with the source file's name as ``shard``."""
    return spark.read.parquet(path).withColumn("shard", F.col("_metadata.file_name"))


def unique_on(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` itself if no key occurs twice, else an error that names one. Starts a job."""
    twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").first()
    if twice is not None:
        raise ValueError(f"not unique: {twice.asDict()}")
    return df


def pin_files(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """(path, length, modified) of the files a run reads: kept with its results, it says what they were made from."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def changed_files(now: DataFrame, pins: DataFrame) -> DataFrame:
    """(path, change) of files that are new, gone or changed since they were pinned."""
    p = pins.select("path", F.col("length").alias("__l"), F.col("modified").alias("__m"))
    both = now.join(p, "path", "full_outer")
    change = F.when(F.col("__l").isNull(), "new").when(F.col("length").isNull(), "gone").when((F.col("length") != F.col("__l")) | (F.col("modified") != F.col("__m")), "changed")
    return both.select("path", change.alias("change")).filter("change IS NOT NULL")


def append_rows(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Rows added to a log of ``fmt`` files; what is there stays. CSV files each begin with their header."""
    df.write.mode("append").format(fmt).option("header", True).save(path)


def write_and_record(df: DataFrame, path: str, ledger: str, key: str) -> int:
    """Write a unit's rows and, only after they are committed, its keys that the ledger lacks; the number of new keys.
    A run that dies in between writes the rows again and records them then."""
    spark = df.sparkSession
    df.write.mode("append").parquet(path)
    keys = df.select(key).distinct()
    try:
        keys = keys.join(spark.read.parquet(ledger), key, "left_anti")
    except AnalysisException:
        pass
    keys = written(keys)
    keys.write.mode("append").parquet(ledger)
    return keys.count()


_WAV = T.StructType([T.StructField("rate", T.IntegerType()), T.StructField("samples", T.ArrayType(T.FloatType()))])


@F.pandas_udf(_WAV)
def wav_span(content, start, end):  # noqa: ANN001, ANN201
    """(rate, samples in [-1, 1)) of the first channel of 16-bit PCM WAV bytes between two times in seconds, sample
    indices rounded; null where the bytes are no such file."""
    import io
    import wave

    import numpy as np
    import pandas as pd

    def one(raw, a, b):  # noqa: ANN001, ANN202
        try:
            with wave.open(io.BytesIO(raw)) as w:
                rate, width, channels = w.getframerate(), w.getsampwidth(), w.getnchannels()
                lo, hi = round(a * rate), min(round(b * rate), w.getnframes())
                w.setpos(min(max(lo, 0), w.getnframes()))
                data = np.frombuffer(w.readframes(max(hi - lo, 0)), "<i2")[::channels] if width == 2 else None
            return None if data is None else (rate, (data / 32768.0).astype(np.float32).tolist())
        except (TypeError, EOFError, wave.Error):
            return None

    made = [one(r, a, b) for r, a, b in zip(content, start, end)]
    return pd.DataFrame([x or (None, None) for x in made], columns=["rate", "samples"])


def provider_text(col: Column) -> Column:
    """Text of a provider's JSON answer: of all batches the events of type 'segments', their texts joined by blanks; null if it does not parse."""
    kind = "array<struct<events: array<struct<type: string, segments: array<struct<text: string>>>>>>"
    events = F.filter(F.flatten(F.transform(F.from_json(col, kind), lambda b: F.coalesce(b["events"], F.array().cast("array<struct<type:string,segments:array<struct<text:string>>>>")))), lambda e: e["type"] == "segments")
    texts = F.flatten(F.transform(events, lambda e: F.transform(e["segments"], lambda s: F.trim(s["text"]))))
    return F.array_join(F.filter(texts, lambda t: t.isNotNull() & (t != "")), " ")


def read_session_docs(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Nested session documents (JSON, also compressed) with the declared schema."""
    return spark.read.schema(SESSION_DOC).option("multiLine", multi_line).json(path)


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, folder and name of files below a path; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "length")
    return files.withColumn("folder", F.element_at(F.split("path", "/"), -2)).withColumn("name", F.element_at(F.split("path", "/"), -1))


def files_by_folder(files: DataFrame) -> DataFrame:
    """(folder, names in order, n, bytes) of ``list_files``."""
    return files.groupBy("folder").agg(F.array_sort(F.collect_set("name")).alias("names"), F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"))


def speaker_map(col: Column) -> Column:
    """Map of number to name from text of lines ``number<tab>name``; other lines are left out, of a repeated number the last line counts."""
    lines = F.transform(F.split(col, "\r?\n"), lambda x: F.split(x, "\t", 2))
    ok = F.filter(lines, lambda x: (F.size(x) == 2) & x[0].rlike(r"^\s*[0-9]+\s*$"))
    pairs = F.transform(ok, lambda x: F.struct(F.trim(x[0]).cast("bigint").alias("k"), F.trim(x[1]).alias("v")))
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(last)


def segment_quality(words: DataFrame, session: str = "session_id", seg: str = "seg", p: str = "p") -> DataFrame:
    """(session, seg, quality, n_words): plain median of the words' probabilities."""
    return words.groupBy(session, seg).agg(F.percentile(p, 0.5).alias("quality"), F.count(F.lit(1)).alias("n_words"))


def words_of_sessions(docs: DataFrame) -> DataFrame:
    """One row per word of nested session documents: session_id, seg, idx, word, t0, t1, p, offset_ok, a, b.

    ``a``, ``b`` are the word's characters in the session's text: the segment's
    start plus the words before it. ``offset_ok`` tells whether the segment's
    text stands verbatim at its start.
    """
    seg = docs.select("session_id", "text", "map", F.posexplode("segments").alias("seg", "s"))
    at = F.get(F.col("map"), F.col("seg"))["start_char"]
    seg = seg.withColumn("base", at).withColumn("offset_ok", F.coalesce(F.substring(F.col("text"), F.col("base") + 1, F.length("s.text")) == F.col("s.text"), F.lit(False)))
    w = seg.select("session_id", "seg", "base", "offset_ok", F.col("s.words").alias("ws"), F.posexplode("s.words").alias("idx", "w"))
    before = F.aggregate(F.slice("ws", F.lit(1), F.col("idx")), F.lit(0), lambda n, x: n + F.length(x["word"]))
    a = F.col("base") + before
    return w.select("session_id", "seg", "idx", F.col("w.word").alias("word"), F.col("w.start").alias("t0"), F.col("w.end").alias("t1"), F.col("w.probability").alias("p"), "offset_ok", a.alias("a"), (a + F.length("w.word")).alias("b"))


def pages(fetch: Callable[[int, int], list[dict]], spark: SparkSession, schema: T.StructType, total: int, page: int = 100) -> DataFrame:
    """Rows of a paged source, one task per page: ``fetch(offset, limit)`` gives a page's rows."""
    fields = pa.schema([(f.name, {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}[f.dataType.simpleString()]) for f in schema.fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for off in b.column(0).to_pylist():
                yield from pa.Table.from_pylist(fetch(off, page), schema=fields).to_batches()

    n = max(1, -(-total // page))
    return spark.range(0, n * page, page, n).mapInArrow(work, schema)


def cached_pages(fetch: Callable[[int, int], list[dict]], spark: SparkSession, schema: T.StructType, total: int, key: str, cache: str, request: str, page: int = 100) -> DataFrame:
    """Rows of a paged source, one per key (of several the greatest), fetched once: they are kept below ``cache`` in a
    folder named by md5 of the request and read from there the next time."""
    at = f"{cache.rstrip('/')}/{hashlib.md5(f'{request}|{total}|{page}'.encode()).hexdigest()}"
    try:
        return spark.read.schema(schema).parquet(at)
    except AnalysisException:
        rows = pages(fetch, spark, schema, total, page)
        one = rows.groupBy(key).agg(F.max(F.struct(*schema.names)).alias("x")).select("x.*")
        one.write.parquet(at)
        return spark.read.schema(schema).parquet(at)


def formatted(df: DataFrame, fmt: str = "%.6g") -> DataFrame:
    """Doubles as text in a fixed number of significant digits, as C's %g writes them (an Arrow UDF: Java's %g differs)."""

    @F.pandas_udf("string")
    def text(x):  # noqa: ANN001, ANN202
        return x.map(lambda v: None if v != v else fmt % v)

    return df.select(*[text(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`") for f in df.schema.fields])


def write_csv(df: DataFrame, path: str, fmt: str = "%.6g") -> None:
    """One table as CSV with a header and fixed significant digits."""
    formatted(df, fmt).write.mode("overwrite").option("header", True).csv(path)


def summary_json(df: DataFrame) -> DataFrame:
    """A one-row table as a JSON document in column ``json``."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested structs as columns named by their path."""

    def walk(schema: T.StructType, prefix: tuple[str, ...]) -> list[Column]:
        out: list[Column] = []
        for f in schema.fields:
            path = (*prefix, f.name)
            if isinstance(f.dataType, T.StructType):
                out += walk(f.dataType, path)
            else:
                out.append(F.col(".".join(f"`{p}`" for p in path)).alias(sep.join(path)))
        return out

    return df.select(*walk(df.schema, ()))


def drop_matching(df: DataFrame, pattern: str) -> DataFrame:
    """``df`` without the columns whose name matches."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if not re.search(pattern, c)])


def transcribe(chunks: DataFrame, audio: str, call: Callable[[bytes], str], key: str = "chunk_id") -> DataFrame:
    """(key, hypothesis, error) of every chunk: ``call`` runs in the tasks; what it raises becomes the row's error."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hyp, err = [], []
            for x in b.column(1).to_pylist():
                try:
                    hyp.append(call(x) if x is not None else None)
                    err.append(None if x is not None else "no audio")
                except Exception as e:  # noqa: BLE001
                    hyp.append(None)
                    err.append(f"{type(e).__name__}: {e}"[:500])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hyp, pa.string()), pa.array(err, pa.string())], names=[key, "hypothesis", "error"])

    return chunks.select(F.col(key).cast("string"), audio).mapInArrow(work, f"`{key}` string, hypothesis string, error string")
