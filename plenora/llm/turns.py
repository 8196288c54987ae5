"""Collapse runs of consecutive events of one entity into one row.

Boundary interval lookup: within each chunk of an entity the positions where a
run starts are gathered into a sorted array, every event finds its run by
binary search in that array, and the runs are aggregated. Chunks bound what a
task sees at once, so an entity with a third of all rows is spread out; the
runs at chunk borders are joined up afterwards from one or two rows per chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Seconds of a session in one chunk.
CHUNK_S = 900.0

_PARTIAL = "session long, chunk long, first_start double, first_end double, first_name string, first_id long, first_voice long, last_start double, last_end double, last_name string, last_id long, last_voice long, max_end double, talk_s double, n_rows long"


def _same(ida: np.ndarray, va: np.ndarray, oka: np.ndarray, idb: np.ndarray, vb: np.ndarray, okb: np.ndarray) -> np.ndarray:
    """Whether neighbours are the same speaker: by id if both have one, else by voice if both have one."""
    named = (ida > 0) & (idb > 0)
    return np.where(named, ida == idb, oka & okb & (va == vb))


def _partial_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of each (session, chunk) of a partition sorted by session, chunk, start, end, filename."""
    held: dict | None = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        col = {k: batch.column(k) for k in batch.schema.names}
        arr = {k: col[k].to_numpy(zero_copy_only=False) for k in ("session", "chunk", "start", "end")}
        ids = pc.fill_null(col["speaker_id"], 0).to_numpy(zero_copy_only=False)
        voice = pc.fill_null(col["local_speaker_id"], 0).to_numpy(zero_copy_only=False)
        has = pc.is_valid(col["local_speaker_id"]).to_numpy(zero_copy_only=False)
        opens = np.ones(n, bool)
        if n > 1:
            one_chunk = (arr["session"][1:] == arr["session"][:-1]) & (arr["chunk"][1:] == arr["chunk"][:-1])
            opens[1:] = ~(one_chunk & _same(ids[:-1], voice[:-1], has[:-1], ids[1:], voice[1:], has[1:]))
        starts = np.flatnonzero(opens)
        run = np.searchsorted(starts, np.arange(n), side="right") - 1
        ends = np.append(starts[1:], n) - 1
        talk = np.bincount(run, arr["end"] - arr["start"], len(starts))
        reach = np.maximum.reduceat(arr["end"], starts)
        size = np.bincount(run, minlength=len(starts))
        out = {"session": arr["session"][starts], "chunk": arr["chunk"][starts]}
        for side, at in (("first", starts), ("last", ends)):
            out |= {f"{side}_start": arr["start"][at], f"{side}_end": arr["end"][at], f"{side}_name": col["filename"].take(pa.array(at)), f"{side}_id": ids[at]}
            out[f"{side}_voice"] = pa.array(voice[at], pa.int64(), mask=~has[at])
        out |= {"max_end": reach, "talk_s": talk, "n_rows": size}
        table = pa.table({k: pa.array(v) if not isinstance(v, (pa.Array, pa.ChunkedArray)) else v for k, v in out.items()})
        rows = table.slice(0, 1).to_pylist()[0]
        if held and _joins(held, rows):
            rows = _joined(held, rows)
        elif held:
            yield from _batches([held])
        if table.num_rows == 1:
            held = rows
            continue
        yield from _batches([rows])
        if table.num_rows > 2:
            yield from _cast(table.slice(1, table.num_rows - 2)).to_batches()
        held = table.slice(table.num_rows - 1, 1).to_pylist()[0]
    if held:
        yield from _batches([held])


def _joins(a: dict, b: dict) -> bool:
    if (a["session"], a["chunk"]) != (b["session"], b["chunk"]):
        return False
    if a["last_id"] > 0 and b["first_id"] > 0:
        return a["last_id"] == b["first_id"]
    return a["last_voice"] is not None and a["last_voice"] == b["first_voice"]


def _joined(a: dict, b: dict) -> dict:
    c = a | {k: v for k, v in b.items() if k.startswith("last_")}
    return c | {"max_end": max(a["max_end"], b["max_end"]), "talk_s": a["talk_s"] + b["talk_s"], "n_rows": a["n_rows"] + b["n_rows"]}


_SCHEMA = pa.schema([(f.split()[0], {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}[f.split()[1]]) for f in _PARTIAL.split(", ")])


def _cast(t: pa.Table) -> pa.Table:
    return t.select(_SCHEMA.names).cast(_SCHEMA)


def _batches(rows: list[dict]) -> list[pa.RecordBatch]:
    return pa.Table.from_pylist(rows, schema=_SCHEMA).to_batches()


def collapse_runs(spans: DataFrame, chunk_s: float = CHUNK_S) -> DataFrame:
    """Maximal runs of the same speaker among a session's spans in order of start, end, filename.

    ``spans`` has filename, session, start, end (not null), speaker_id and
    local_speaker_id. Neighbours are the same speaker when both ids are
    positive and equal or, if either id is 0 or null, when both local ids are
    present and equal; pauses do not end a run. Rows equal in start and end are
    ordered by filename. Other columns are ignored. Empty input gives no rows.

    Output: session, first_filename, last_filename, start, end (latest end of
    any row), talk_s (sum of the rows' durations), n_rows.
    """
    keyed = spans.select("session", F.floor(F.col("start") / chunk_s).cast("long").alias("chunk"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), "filename", F.col("speaker_id").cast("long").alias("speaker_id"), F.col("local_speaker_id").cast("long").alias("local_speaker_id"))
    ordered = keyed.repartition("session", "chunk").sortWithinPartitions("session", "chunk", "start", "end", "filename")
    partial = ordered.mapInArrow(_partial_runs, _PARTIAL)

    in_chunk = W.partitionBy("session", "chunk")
    order = ["first_start", "first_end", "first_name"]
    sided = partial.withColumn("__up", F.row_number().over(in_chunk.orderBy(*order))).withColumn("__n", F.count(F.lit(1)).over(in_chunk))
    inner = sided.filter("__up > 1 AND __up < __n")
    edges = sided.filter("__up = 1 OR __up = __n")
    w = W.partitionBy("session").orderBy("chunk", *order)
    before = F.lag(F.struct("last_id", "last_voice")).over(w)
    same = F.when((before["last_id"] > 0) & (F.col("first_id") > 0), before["last_id"] == F.col("first_id")).otherwise(F.coalesce(before["last_voice"] == F.col("first_voice"), F.lit(False)))
    # Two edges of one chunk are never neighbours that could join, unless nothing lies between them; then the chunk's own runs already differ.
    opened = edges.withColumn("__new", F.when(before.isNull() | ~same | ((F.col("__up") > 1)), 1).otherwise(0))
    runs = opened.withColumn("__run", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    key = F.struct("chunk", *order)
    joined = runs.groupBy("session", "__run").agg(
        F.min_by("first_name", key).alias("first_filename"), F.max_by("last_name", key).alias("last_filename"), F.min("first_start").alias("start"), F.max("max_end").alias("end"), F.sum("talk_s").alias("talk_s"), F.sum("n_rows").alias("n_rows")
    )
    cols = ["session", "first_filename", "last_filename", "start", "end", "talk_s", "n_rows"]
    plain = inner.select("session", F.col("first_name").alias("first_filename"), F.col("last_name").alias("last_filename"), F.col("first_start").alias("start"), F.col("max_end").alias("end"), "talk_s", "n_rows")
    return joined.select(*cols).unionByName(plain.select(*cols))
