"""Evaluation passages inside training documents.

Greedy string tiling of documents against the items they share seeds with.

1. Documents are read once. Every word becomes a 32-bit number and every place
   gives rolling Karp-Rabin hashes of its seeds: runs of five words, and runs of
   four with two more words beyond a gap of at most one. Any passage of twelve
   words with up to two of them wrong holds such a seed. Seeds that may be an
   item's (a bit set of bounded size) are kept, with the words around them as
   bytes, beside the document's words and its short sentences.
2. The seeds of documents and items are joined; a pair stays if the words around
   the seed agree closely enough. Seeds that fill a large share of either side
   are salted.
3. Each (document, item) that is left is tiled: the longest unmarked matches are
   marked again and again, by Karp-Rabin with falling lengths, and a chain of
   tiles in the item's order decides.
4. Short sentences that stand in many texts which do not leak an item with that
   sentence are fixed phrases; passages that need their words are taken back.

No item, seed or document comes to the driver. Bit sets do, and their size has
a stated bound.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenora.llm.canon import Canoniser
from plenora.operators.skew import filter_bits, hot_keys, in_filter, key_filter, salted_join
from plenora.session import written

MIN_WORDS = 12
#: One word in so many may be changed, missing or added.
PER_ERROR = 6
#: A sentence of at most this many words that stands in at least PHRASE_SHARE of the distinct texts, those that leak an item with it left out, is a fixed phrase.
PHRASE_WORDS, PHRASE_SHARE, PHRASE_LEAST = 8, 0.001, 5
_BASE, _MASK = np.uint64(0x9E3779B97F4A7C15), (1 << 64) - 1

_TIME = re.compile(r"[\[(]?\b\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d+)?\b[\])]?")
_NUMBERED = re.compile(r"^[^\S\n]*\(?\d{1,3}[.)](?=\s)", re.M)
_LABEL = re.compile(r"^[^\n.!?:]{1,40}:[^\S\n]*$", re.M)
_WORD = re.compile(r"[^\W_]+(?:['\"][^\W_]+)*")
_SENTENCE = re.compile(r"[.!?:;\n…]+")

#: Blanks between texts laid end to end, and how far around a seed words are kept and by how much they may be shifted.
_PAD, _BEFORE, _AFTER, _SHIFT = 24, 9, 12, MIN_WORDS // PER_ERROR


def words_of(text: str, form: Canoniser) -> list[str]:
    """Words in one form: times, list numbers and speaker labels on lines of their own are marks, not words."""
    bare = text
    if ":" in bare:
        bare = _LABEL.sub(" ", _TIME.sub(" ", bare))
    return _WORD.findall(form(_NUMBERED.sub(" ", bare)))


class WordNumbers(dict):
    """Callable words -> 32-bit numbers, never 0: the same on every executor. Remembers what it has seen, up to a bound."""

    def __missing__(self, word: str) -> int:
        n = self[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little") or 1
        return n

    def __call__(self, words: list[str]) -> np.ndarray:
        if len(self) > 500_000:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint32, len(words))


def _hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes (mod 2**64) of all runs of k ids."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    x, out = ids.astype(np.uint64), np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _BASE + x[j : j + n]
    return out ^ (out >> np.uint64(29))


def seeds(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of every seed of texts laid end to end with blanks (0) between.

    Ten right words of twelve lie in three runs at most. Either one run has
    five words, or one has four and another of at least two begins or ends one
    wrong, missing or added word away from it.
    """
    blank = np.concatenate([[0], np.cumsum(flat == 0)])
    four, two = _hashes(flat, 4), _hashes(flat, 2)
    at, out = [], []

    def add(h: np.ndarray, span: int, kind: int) -> None:
        h = h[: max(0, len(flat) - span + 1)]
        ok = np.flatnonzero(blank[span : span + len(h)] == blank[: len(h)])
        at.append(ok)
        mixed = (h[ok] + np.uint64(kind)) * _BASE
        out.append(mixed ^ (mixed >> np.uint64(31)))

    add(_hashes(flat, 5), 5, 0)
    for gap in (0, 1):
        n = max(0, len(flat) - 6 - gap + 1)
        add(four[:n] * _BASE + two[4 + gap : 4 + gap + n], 6 + gap, 1)
        add(two[:n] * _BASE + four[2 + gap : 2 + gap + n], 6 + gap, 2)
    return np.concatenate(at), np.concatenate(out)


def _laid(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(all words end to end with blanks before, between and after; where each text begins)."""
    parts, begin, pos = [np.zeros(_PAD, np.uint32)], [], _PAD
    for t in texts:
        begin.append(pos)
        parts += [t, np.zeros(_PAD, np.uint32)]
        pos += len(t) + _PAD
    return np.concatenate(parts), np.array(begin, np.int64)


def _around(flat: np.ndarray, at: np.ndarray, more: int, blank: int) -> pa.Array:
    """The words around each place as one byte each; blanks get a byte of their own."""
    small = np.where(flat == 0, blank, flat % np.uint32(254) + 1).astype(np.uint8)
    width = _BEFORE + _AFTER + 2 * more
    view = np.lib.stride_tricks.sliding_window_view(small, width)[at - _BEFORE - more]
    return pa.Array.from_buffers(pa.binary(width), len(at), [None, pa.py_buffer(np.ascontiguousarray(view))]).cast(pa.binary())


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _phrase(words: np.ndarray) -> int:
    """What ``_hashes`` gives for all of a few words, with their number, as a signed 64-bit number."""
    h = 0
    for w in words.tolist():
        h = (h * int(_BASE) + w) & _MASK
    h = ((h ^ (h >> 29)) + len(words)) & _MASK
    return h - (1 << 64) if h >> 63 else h


def short_sentences(text: str, form: Canoniser, number: WordNumbers, memo: dict[str, int]) -> set[int]:
    """Hashes of the text's sentences of 2 to PHRASE_WORDS words."""
    out = set()
    for s in {s for s in map(str.strip, _SENTENCE.split(text)) if 3 < len(s) < 90 and s.count(" ") < PHRASE_WORDS + 2}:
        if s not in memo:
            if len(memo) > 200_000:
                memo.clear()
            ws = _WORD.findall(form(s))
            memo[s] = _phrase(number(ws)) if 2 <= len(ws) <= PHRASE_WORDS else 0
        if memo[s]:
            out.add(memo[s])
    return out


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


_ROWS = ("kind", "unit", "digest", "ids", "words", "key", "at", "around")


def scan_documents(docs: DataFrame, doc_id: str, text_col: str, bits: np.ndarray) -> DataFrame:
    """What one reading of the documents gives, as rows of three kinds.

    0: a text (``unit``, its digest, the ids of the batch's rows that have it and, if it holds a seed, its words);
    1: a seed (unit, key, place, the words around it); 2: a short sentence (key) of a text (digest).
    Equal texts of a batch are one unit, so a text that fills a third of all
    rows is worked on once per batch. Units are numbered by partition and order.
    """
    id_type = docs.schema[doc_id].dataType.simpleString()
    types = [pa.int8(), pa.int64(), pa.int64(), pa.list_(_arrow(id_type)), pa.binary(), pa.int64(), pa.int32(), pa.binary()]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        form, number, memo = Canoniser(fold_case=True, strip_marks=True), WordNumbers(), {}
        unit = TaskContext.get().partitionId() << 33

        def batch(n: int, kind: int, **cols: pa.Array) -> pa.RecordBatch:
            have = cols | {"kind": pa.array(np.full(n, kind, np.int8))}
            return pa.RecordBatch.from_arrays([have[c].cast(t) if c in have else pa.nulls(n, t) for c, t in zip(_ROWS, types)], names=list(_ROWS))

        for b in batches:
            enc = b.column(1).dictionary_encode()
            if not len(enc.dictionary):
                continue
            texts, code = enc.dictionary.to_pylist(), enc.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            edges = np.searchsorted(code[order], np.arange(len(texts) + 1))
            words = [number(words_of(t, form)) for t in texts]
            flat, begin = _laid(words)
            at, h = seeds(flat)
            maybe = in_filter(bits, h)
            at, h = at[maybe], h[maybe]
            of = np.searchsorted(begin, at, "right") - 1
            held = np.zeros(len(texts), bool)
            held[of] = True
            digests = [_digest(t) for t in texts]
            units = unit + np.arange(len(texts))
            unit += len(texts)
            ids = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), b.column(0).take(pa.array(order)))
            yield batch(len(texts), 0, unit=pa.array(units), digest=pa.array(digests, pa.int64()), ids=ids, words=pa.array([w.tobytes() if k else None for w, k in zip(words, held)], pa.binary()))
            for k in range(0, len(at), 50_000):
                s = slice(k, k + 50_000)
                yield batch(len(at[s]), 1, unit=pa.array(units[of[s]]), key=pa.array(h[s].view(np.int64)), at=pa.array((at[s] - begin[of[s]]).astype(np.int32)), around=_around(flat, at[s], _SHIFT, 0))
            said, where = [], []
            for t, d in zip(texts, digests):
                own = short_sentences(t, form, number, memo)
                said += own
                where += [d] * len(own)
            yield batch(len(said), 2, key=pa.array(said, pa.int64()), digest=pa.array(where, pa.int64()))

    rows = docs.select(doc_id, text_col).filter(F.col(text_col).isNotNull() & (F.col(text_col) != ""))
    return rows.mapInArrow(work, f"kind byte, unit long, digest long, ids array<{id_type}>, words binary, key long, at int, around binary")


def item_words(items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """(item, id, words as 32-bit numbers) of every item text of at least MIN_WORDS words; ``item`` is a number of its own per id and text."""
    kind = items.schema[item_id].dataType.simpleString()

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form, number = Canoniser(fold_case=True, strip_marks=True), WordNumbers()
        for b in batches:
            made = [number(words_of(t, form)) for t in b.column(2).to_pylist()]
            ok = pa.array([len(w) >= MIN_WORDS for w in made], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([w.tobytes() for w in made], pa.binary())], names=["item", "id", "words"]).filter(ok)

    some = items.select(F.col(item_id).alias("id"), F.col(item_text).alias("t")).filter("id IS NOT NULL AND t IS NOT NULL AND t <> ''").distinct()
    return some.select(F.xxhash64("id", "t").alias("item"), "id", "t").mapInArrow(work, f"item long, id {kind}, words binary")


def item_seeds(words: DataFrame) -> DataFrame:
    """(key, item, around) of every seed of every item."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                flat, begin = _laid([np.frombuffer(w, np.uint32) for w in b.column("words").to_pylist()])
                at, h = seeds(flat)
                of = np.searchsorted(begin, at, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), b.column(0).take(pa.array(of)), _around(flat, at, 0, 255)], names=["key", "item", "around"])

    return words.mapInArrow(work, "key long, item long, around binary")


def agreeing(pairs: DataFrame) -> DataFrame:
    """(unit, item, at) of the seed pairs with ten words of some twelve around them alike, shifted by two at most."""
    width, wide = _BEFORE + _AFTER, _BEFORE + _AFTER + 2 * _SHIFT

    def plain(a: pa.Array, n: int) -> np.ndarray:
        return np.frombuffer(b"".join(a.to_pylist()), np.uint8).reshape(-1, n)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                doc, want = plain(b.column(3), wide), plain(b.column(4), width)
                same = np.zeros(want.shape, bool)
                for d in range(2 * _SHIFT + 1):
                    same |= doc[:, d : d + width] == want
                run = np.cumsum(np.concatenate([np.zeros((len(same), 1), bool), same], axis=1), axis=1, dtype=np.int16)
                keep = (run[:, MIN_WORDS:] - run[:, :-MIN_WORDS]).max(1) >= MIN_WORDS - MIN_WORDS // PER_ERROR
                yield b.select(["unit", "item", "at"]).filter(pa.array(keep))

    return pairs.select("unit", "item", "at", "d_around", "i_around").mapInArrow(work, "unit long, item long, at int")


def tiles(a: np.ndarray, b: np.ndarray, least: int = 1) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in a, start in b, length) of non-overlapping matches, longest first."""
    free_a, free_b, out = np.ones(len(a), bool), np.ones(len(b), bool), []
    length = 1 << max(0, int(math.log2(max(1, min(len(a), len(b))))))
    while length >= least:
        ha, hb = _hashes(a, length), _hashes(b, length)
        open_a, open_b = (np.convolve(~f, np.ones(length, int))[length - 1 : len(f)] == 0 for f in (free_a, free_b))
        place: dict[int, list[int]] = {}
        for q in np.flatnonzero(open_b).tolist():
            place.setdefault(int(hb[q]), []).append(q)
        found = []
        for p in np.flatnonzero(open_a).tolist():
            for q in place.get(int(ha[p]), ()):
                n = 0
                while p + n < len(a) and q + n < len(b) and a[p + n] == b[q + n] and free_a[p + n] and free_b[q + n]:
                    n += 1
                if n >= length:
                    found.append((-n, p, q))
        for n, p, q in sorted(found):
            if free_a[p : p - n].all() and free_b[q : q - n].all():
                free_a[p : p - n] = free_b[q : q - n] = False
                out.append((p, q, -n))
        length //= 2
    return out


def chain_holds(t: list[tuple[int, int, int]], content: np.ndarray) -> bool:
    """Whether a chain of tiles in order covers MIN_WORDS words of the item (``content`` marks those that are no fixed
    phrases) with no more than one word in PER_ERROR changed, missing or added."""
    t = sorted(t, key=lambda x: (x[1], x[0]))
    words = np.concatenate([[0], np.cumsum(content)]).tolist()
    # No passage has a gap of more errors than the whole item allows; tiles do not overlap, so each has few before it.
    widest = len(content) // PER_ERROR
    before: list[list[tuple[int, int]]] = []  # per tile the tiles that may go before it, with the errors between
    for j, (p, q, _) in enumerate(t):
        near, i = [], j - 1
        while i >= 0 and q - t[i][1] - t[i][2] <= widest:
            ga = p - t[i][0] - t[i][2]
            if 0 <= ga <= widest:
                near.append((i, max(ga, q - t[i][1] - t[i][2])))
            i -= 1
        before.append(near)
    # First and last tile fix the words of a chain, so the fewest errors between each two decide.
    for start, (_, first, _) in enumerate(t):
        if words[-1] - words[first] < MIN_WORDS:
            break
        fewest = {start: 0}
        for j in range(start, len(t)):
            if j > start:
                wrong = min((fewest[i] + e for i, e in before[j] if i in fewest), default=None)
                if wrong is None:
                    continue
                fewest[j] = wrong
            end = t[j][1] + t[j][2]
            if words[end] - words[first] >= MIN_WORDS and fewest[j] * PER_ERROR <= end - first:
                return True
    return False


def holds_passage(a: np.ndarray, b: np.ndarray, content: np.ndarray) -> bool:
    """Whether text ``a`` holds a passage of item ``b``; see ``chain_holds``."""
    return chain_holds(tiles(a, b), content)


def tiled(found: DataFrame) -> DataFrame:
    """(unit, digest, item, id, words of the item, tiles) of every stretch of a text that holds a passage, all words counted.

    ``found`` has unit, digest, item, id, ats (places of seeds), words (of the text), i_words.
    """
    kind = found.schema["id"].dataType.simpleString()

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, size, made = [], [], []
            for r, (ats, text, item) in enumerate(zip(*(b.column(k).to_pylist() for k in ("ats", "words", "i_words")))):
                a, i = np.frombuffer(text, np.uint32), np.frombuffer(item, np.uint32)
                reach, last = len(i) + 16, None
                for p in ats:
                    # A stretch already tiled holds the seeds of its inner part with all that surrounds them.
                    if last is not None and p < last + reach // 2:
                        continue
                    last = p
                    t = tiles(a[max(0, p - reach) : p + reach], i)
                    if chain_holds(t, np.ones(len(i), bool)):
                        row.append(r)
                        size.append(len(i))
                        made.append(np.array(t, np.int32).tobytes())
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in ("unit", "digest", "item", "id")), pa.array(size, pa.int32()), pa.array(made, pa.binary())], names=["unit", "digest", "item", "id", "size", "tiles"])

    return found.select("unit", "digest", "item", "id", "ats", "words", "i_words").mapInArrow(work, f"unit long, digest long, item long, id {kind}, size int, tiles binary")


def phrase_places(words: DataFrame, bits: np.ndarray) -> DataFrame:
    """(key, item, first, n): where in an item a sequence of 2 to PHRASE_WORDS words stands that may be in the bit set."""
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, key, first, size = [], [], [], []
            for r, raw in enumerate(b.column("words").to_pylist()):
                w = np.frombuffer(raw, np.uint32)
                for n in range(2, PHRASE_WORDS + 1):
                    h = _hashes(w, n) + np.uint64(n)
                    for p in np.flatnonzero(in_filter(bits, h)).tolist():
                        row.append(r)
                        key.append(int(h[p : p + 1].view(np.int64)[0]))
                        first.append(p)
                        size.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), b.column("item").take(pa.array(row, pa.int64())), pa.array(first, pa.int32()), pa.array(size, pa.int32())], names=["key", "item", "first", "n"])

    return words.mapInArrow(work, "key long, item long, first int, n int")


def kept(found: DataFrame) -> DataFrame:
    """(unit, id) of the stretches that hold a passage also when the words of fixed phrases (``fixed``: first, n) do not count."""
    kind = found.schema["id"].dataType.simpleString()

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for size, raw, fixed in zip(*(b.column(k).to_pylist() for k in ("size", "tiles", "fixed"))):
                content = np.ones(size, bool)
                for x in fixed or ():
                    content[x["first"] : x["first"] + x["n"]] = False
                ok.append(not fixed or chain_holds([tuple(x) for x in np.frombuffer(raw, np.int32).reshape(-1, 3).tolist()], content))
            yield b.select(["unit", "id"]).filter(pa.array(ok, pa.bool_()))

    return found.select("unit", "id", "size", "tiles", "fixed").mapInArrow(work, f"unit long, id {kind}")


def leaks(docs: DataFrame, doc_id: str, text_col: str, items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """(doc_id, item_id) of every document row that holds a passage of an item.

    Whole texts are read, once; null and empty texts, null ids and items of
    fewer than MIN_WORDS words give no row. Each copy of a document counts by
    its own row; repeated (doc, item) rows are reduced to one. Several texts
    under one item id are all looked for. Starts jobs when called.

    A sentence is a fixed phrase by the texts that say it without leaking an
    item that holds it, so an item's own sentences count however widely it
    leaks. One said only where one item leaks cannot be told from the item.
    """
    words = written(item_words(items, item_id, item_text))
    asked = item_seeds(words)
    log2 = filter_bits(5 * (words.agg(F.sum(F.length("words") / 4)).first()[0] or 0))
    read = written(scan_documents(docs, doc_id, text_col, key_filter(asked, F.col("key"), log2)), "kind")
    units = read.filter("kind = 0").select("unit", "digest", "ids", "words")
    own = read.filter("kind = 1").select("key", "unit", "at", F.col("around").alias("d_around"))
    said = read.filter("kind = 2").select("key", "digest").distinct()

    # Only seeds that some document may hold are shuffled on the items' side.
    n_own = own.count()
    theirs = _passing(asked, key_filter(own, F.col("key"), filter_bits(n_own))).select("key", "item", F.col("around").alias("i_around"))
    pairs = salted_join(own, theirs, "key", hot_keys(own, "key", n_own), ["unit", "at"])
    near = written(agreeing(pairs).groupBy("unit", "item").agg(F.array_sort(F.collect_set("at")).alias("ats")))
    numbered = words.select("item", "id", F.col("words").alias("i_words"))
    n_near = near.count()
    some = _passing(units.filter("words IS NOT NULL"), key_filter(near, F.xxhash64("unit"), filter_bits(n_near)), "unit")
    full = salted_join(near.join(some.select("unit", "digest", "words"), "unit"), numbered, "item", hot_keys(near, "item", n_near), ["unit"])
    leaked = written(tiled(full))

    least = max(PHRASE_LEAST, math.ceil(units.select("digest").distinct().count() * PHRASE_SHARE))
    often = written(said.groupBy("key").agg(F.count(F.lit(1)).alias("n_texts")).filter(F.col("n_texts") >= least))
    places = phrase_places(words, key_filter(often, F.col("key"), filter_bits(often.count(), 23))).join(often, "key")
    hot_items = hot_keys(leaked, "item", leaked.count())
    owned = salted_join(leaked.select("digest", "item").distinct(), places.select("item", "key").distinct(), "item", hot_items, ["digest"]).select("key", "digest").distinct()
    n_owned = owned.join(said, ["key", "digest"], "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("n_owned"))
    fixed = often.join(n_owned, "key", "left").filter(F.col("n_texts") - F.coalesce("n_owned", F.lit(0)) >= least)
    marks = places.join(fixed.select("key"), "key", "left_semi").groupBy("item").agg(F.collect_set(F.struct("first", "n")).alias("fixed"))
    final = kept(salted_join(leaked, marks, "item", hot_items, ["unit"], "left"))
    rows = final.distinct().join(units.select("unit", F.explode("ids").alias(doc_id)), "unit").filter(F.col(doc_id).isNotNull())
    return rows.select(doc_id, F.col("id").alias(item_id)).distinct()


def _passing(df: DataFrame, bits: np.ndarray, key: str | None = None) -> DataFrame:
    """Rows whose ``key`` column (itself a hash, or with ``key`` given the xxhash64 of that column) may be in the bit set."""
    hashed = df.withColumn("__h", F.xxhash64(key) if key else F.col("key"))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(in_filter(bits, b.column("__h").to_numpy(zero_copy_only=False).view(np.uint64))))

    return hashed.mapInArrow(work, hashed.schema).drop("__h")
