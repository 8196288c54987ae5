"""Documents combined into sequences of fixed capacity with little unused space.

First-fit decreasing by a tournament tree over the bins' free capacities: each
inner node holds the largest free capacity below it, so the first bin that
takes an item is found by one descent. Documents are dealt to groups by hash
and every group is packed on its own; with some thousand documents a group, the
one partly filled bin that a group may add is negligible.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A public byte-level BPE vocabulary as ranks; a path on the driver, from where its bytes (about a megabyte) go to the tasks.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pre-tokenisation pattern published with that vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def token_counts(df: DataFrame, id_col: str, text_col: str, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(id, n_tokens) of every row, of whole texts; null and empty texts have 0 tokens.

    Equal texts of an Arrow batch are encoded once. Strings of special tokens
    in a text are ordinary text.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    with open(vocabulary, "rb") as f:
        lines = df.sparkSession.sparkContext.broadcast(f.read())

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.value.splitlines())}
        encode = tiktoken.Encoding("documents", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for b in batches:
            enc = b.column(1).dictionary_encode()
            sizes = pa.array([len(encode(t)) for t in enc.dictionary.to_pylist()], pa.int64())
            n = sizes.take(enc.indices).fill_null(0) if len(sizes) else pa.array([0] * b.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), n], names=[id_col, "n_tokens"])

    return df.select(id_col, text_col).mapInArrow(work, f"`{id_col}` {id_type}, n_tokens long")


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item (sizes in falling order, none above ``capacity``), by a tournament tree."""
    n = len(sizes)
    leaves = 1 << max(0, math.ceil(math.log2(max(n, 1))))
    tree = [capacity] * (2 * leaves)
    out = np.empty(n, np.int64)
    for i, size in enumerate(sizes.tolist()):
        at = 1
        while at < leaves:
            at *= 2
            if tree[at] < size:
                at += 1
        out[i] = at - leaves
        tree[at] -= size
        while at > 1:
            at //= 2
            a, b = tree[2 * at], tree[2 * at + 1]
            tree[at] = a if a > b else b
    return out


def pack(sizes: DataFrame, id_col: str, capacity: int, group_size: int = 8192, total: int | None = None, seed: int = 17) -> DataFrame:
    """Place every (id, n_tokens) row in a bin of ``capacity`` tokens.

    A row larger than the capacity is cut into full pieces, each a bin of its
    own, and a rest that is placed like any other row; nothing else is cut.
    Rows repeated with the same id and size are counted first and dealt out one
    by one, so no group grows with the repetitions of an id. Rows of 0 tokens
    need no place: their bin is null. ``total`` is the number of rows (counted
    if not given) and sets the number of groups.

    Output: id, copy (0 for the first row of that id and size), piece,
    n_tokens (of the piece), grp, bin (within grp), start (token offset in bin).
    """
    if total is None:
        total = sizes.count()
    groups = max(1, math.ceil(total / group_size))
    id_type = sizes.schema[id_col].dataType.simpleString()
    same = sizes.groupBy(id_col, "n_tokens").agg(F.count(F.lit(1)).alias("__k"))
    each = same.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__k") - 1))).drop("__k")
    dealt = each.withColumn("grp", F.pmod(F.xxhash64(F.lit(seed), id_col, "n_tokens", "copy"), F.lit(groups)).cast("int"))
    schema = f"`{id_col}` {id_type}, copy long, piece int, n_tokens long, grp int, bin long, start long"

    def work(key: tuple, table: pa.Table) -> pa.Table:
        n = table.column("n_tokens").to_numpy()
        rows = np.arange(len(n))
        full = n // capacity
        whole = np.repeat(rows, full)
        piece_full = np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)
        rest = n % capacity
        keep = np.flatnonzero(rest)
        # Falling size; ties by id and copy, so the order of arrival plays no part.
        ids = np.array([str(x) for x in table.column(id_col).to_pylist()])
        order = keep[np.lexsort((table.column("copy").to_numpy()[keep], ids[keep], -rest[keep]))]
        placed = first_fit_decreasing(rest[order], capacity)
        used = int(placed.max()) + 1 if len(placed) else 0
        by_bin = np.argsort(placed, kind="stable")
        run = np.cumsum(rest[order][by_bin]) - rest[order][by_bin]
        first = np.searchsorted(placed[by_bin], np.arange(used))
        start = np.empty(len(order), np.int64)
        start[by_bin] = run - (run[first][placed[by_bin]] if used else 0)
        wf = whole[np.lexsort((piece_full, ids[whole]))] if len(whole) else whole
        pf = piece_full[np.lexsort((piece_full, ids[whole]))] if len(whole) else piece_full
        none = np.flatnonzero(n == 0)  # they need no place
        at = np.concatenate([order, wf, none]).astype(np.int64)
        void = np.arange(len(at)) >= len(order) + len(wf)
        cols = {
            id_col: table.column(id_col).take(pa.array(at)), "copy": table.column("copy").take(pa.array(at)),
            "piece": pa.array(np.concatenate([full[order], pf, 0 * none]).astype(np.int32)), "n_tokens": pa.array(np.concatenate([rest[order], np.full(len(wf), capacity), 0 * none]).astype(np.int64)),
            "grp": pa.array(np.full(len(at), key[0].as_py(), np.int32), mask=void), "bin": pa.array(np.concatenate([placed, used + np.arange(len(wf)), none]).astype(np.int64), mask=void),
            "start": pa.array(np.concatenate([start, np.zeros(len(wf)), none]).astype(np.int64), mask=void),
        }
        return pa.table(cols)

    return dealt.groupBy("grp").applyInArrow(work, schema)
