"""Texts cut off by a field limit or in transfer.

A cut value is a strict prefix of a longer one. That is looked for by self-joins
by prefix at three grains: the whole value (values are sorted and each is
compared with its successor, of which it must then be a prefix), the last word
(a word that never stands alone but begins longer words) and the length (many
values of a source that end at one length are the prefixes that a field limit
leaves). Few cut texts have a longer copy, so the finer grains decide most
cases, together with how texts of a source end when they are complete.

Each different text is read by Python once, wherever its copies lie: one pass
gives how it ends, its words' uses and the letters by which values are sorted.
Evidence is gathered per (source, text); rows take it from there.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plenora.llm.canon import Canoniser
from plenora.operators.skew import filter_bits, hot_keys, in_filter, key_filter, lookup_join, salted_join
from plenora.session import written

# Marks that tools put after a cut: an ellipsis, or one short remark in brackets on the line of the text.
_DOTS = re.compile(r"\s*[\[(]?\s*(?:\.{2,}|…)\s*[\])]?\s*$")
_REMARK = re.compile(r"[^\S\n]*(?:\[[^\W\d_]{2,12}\.?\]|\([^\W\d_]{2,12}\.?\))\s*$")
_NOTE = re.compile(r"(?:^|\n)[^\S\n]*[\[(][^\])\n]{4,120}[\])]$")
_WORD = re.compile(r"[^\W_]+(?:['\"][^\W_]+)*")
#: A full stop, also inside closing quotes or brackets, or a whole word in quotes, after which some texts set none.
_END = re.compile(r"(?:[.?!؟。！？]+[\"')\]]*|(?:^|\s)\"[^\s\"]+\")$")
#: A word with no more than this share of its uses at the end of a sentence or line cannot end one.
NEVER_LAST = 0.005
#: Uses from which that share is trusted.
ATTESTED = 20
#: A word that only ends texts is a beginning if the texts are at most so many times the uses of the longer words it begins.
LAST_TIMES = 2
#: A source's texts end with a full stop (or a sign-off) as a rule from this share on.
RULE_SHARE = 0.3
#: A length is a limit if so many distinct texts have it, so many times what the lengths within SPIKE_REACH have on
#: average, and this share of what the source's most frequent length has.
SPIKE_LEAST, SPIKE_TIMES, SPIKE_REACH, SPIKE_OF_TOP = 5, 8.0, 24, 0.1

#: Values sampled per partition to set the borders of the sort, and how many letters of each come to the driver.
SAMPLE_A_PART, BORDER = 50, 256
#: A value of fewer letters is no beginning, and values are compared only if they share their first so many letters.
HEAD = 24


def _ending(text: str, form: Canoniser) -> dict:
    """What the end of a text shows. Only the last few hundred characters are put in one form."""
    # The form maps line breaks to blanks; lines are therefore formed one by one.
    lines = [form(x) for x in text.rstrip()[-600:].split("\n")]
    lines = [x for x in lines if x]
    end = lines[-1] if lines else ""
    broken = end.endswith("�")
    end = end.rstrip("� ")
    bare = _DOTS.sub("", end)
    dotted = bare != end
    noted = bool(_NOTE.search("\n" + end)) and not dotted
    plain = bare if noted else _REMARK.sub("", bare)
    # A remark counts as a mark only where the text before it is not closed.
    marked = dotted or (plain != bare and not _END.search(plain))
    end = plain if marked else end
    words = _WORD.findall(end)
    closed = not marked and not broken and (noted or bool(_END.search(end)))
    return {
        "broken": broken, "marked": marked, "closed": closed, "tail": words[-1] if words and end.rstrip("'\"").endswith(words[-1]) else None,
        "prior": lines[-2] if len(lines) > 1 else None, "short": len(words) <= 4,
    }


_TOKEN = re.compile(r"[^\W_]+(?:['\"][^\W_]+)*|[.?!؟\n]")
_STOPS = ".?!؟\n"
_COLUMNS = {
    "kind": pa.int8(), "digest": pa.binary(), "chars": pa.int64(), "bytes": pa.int64(), "broken": pa.bool_(), "marked": pa.bool_(), "closed": pa.bool_(), "tail": pa.string(), "prior": pa.string(),
    "short": pa.bool_(), "letters": pa.string(), "head": pa.int64(), "word": pa.string(), "n": pa.int64(), "n_end": pa.int64(), "n_last": pa.int64(),
}


def scan_texts(texts: DataFrame, text_col: str) -> DataFrame:
    """What one reading of distinct texts gives, as rows of two kinds.

    0: a text that is not blank: md5 digest, sizes, how it ends, its letters and
    digits if there are at least HEAD of them, and a hash of the first HEAD;
    1: a word with its uses other than as a text's last word, those of them that
    end a sentence or line, and its uses as the last word of a text, summed over
    a batch. Marks after a cut are taken off before words and letters are taken.
    """
    names = {pa.int8(): "byte", pa.binary(): "binary", pa.int64(): "long", pa.bool_(): "boolean", pa.string(): "string"}

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form, plain = Canoniser(fold_case=True, strip_marks=True), Canoniser(fold_case=True, strip_marks=True, trim=False, lines=True)

        def batch(size: int, kind: int, **cols: list) -> pa.RecordBatch:
            have = cols | {"kind": [kind] * size}
            return pa.RecordBatch.from_arrays([pa.array(have[c], t) if c in have else pa.nulls(size, t) for c, t in _COLUMNS.items()], names=list(_COLUMNS))

        for b in batches:
            rows: dict[str, list] = {c: [] for c in ("digest", "chars", "bytes", "broken", "marked", "closed", "tail", "prior", "short", "letters", "head")}
            uses, ends, lasts = Counter(), Counter(), Counter()
            for t in b.column(0).to_pylist():
                if not t or not t.strip():
                    continue
                raw = t.encode("utf-8", "surrogatepass")
                bare = t.rstrip().rstrip("�")
                # Only the end can hold marks of a cut; the rest is not searched for them.
                bare = bare[:-400] + _REMARK.sub("", _DOTS.sub("", bare[-400:]))
                ws = _TOKEN.findall(plain(bare))
                letters = "".join(w for w in ws if w not in _STOPS).replace("'", "").replace('"', "")
                long = len(letters) >= HEAD
                made = _ending(t, form) | {
                    "digest": hashlib.md5(raw).digest(), "chars": len(t), "bytes": len(raw), "letters": letters if long else None,
                    "head": int.from_bytes(hashlib.blake2b(letters[:HEAD].encode(), digest_size=8).digest(), "big", signed=True) if long else None,
                }
                for c, values in rows.items():
                    values.append(made[c])
                while ws and ws[-1] in _STOPS:
                    ws.pop()
                if ws:
                    lasts[ws.pop()] += 1
                    uses.update(ws)
                    ends.update(w for w, x in zip(ws, ws[1:]) if x in _STOPS)
            yield batch(len(rows["digest"]), 0, **rows)
            words = [w for w in uses.keys() | lasts.keys() if w not in _STOPS]
            yield batch(len(words), 1, word=words, n=[uses[w] for w in words], n_end=[ends[w] for w in words], n_last=[lasts[w] for w in words])

    return texts.select(text_col).mapInArrow(work, ", ".join(f"{c} {names[t]}" for c, t in _COLUMNS.items()))


def prefix_copies(texts: DataFrame) -> DataFrame:
    """Digests of the texts (digest, letters, head) whose letters are a strict prefix of another text's.

    Only texts whose first HEAD letters another text shares are sorted over the
    cluster; a value that is a prefix of any other is a prefix of the next
    different one. Values that end a sorted partition meet the first value of
    the next in a second, tiny step. Borders are BORDER letters long.
    """
    spark = texts.sparkSession
    long = texts.filter("letters IS NOT NULL")
    shared = written(long.groupBy("head").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("head"))
    bits = key_filter(shared, F.col("head"), filter_bits(shared.count()))

    def passing(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(in_filter(bits, b.column(2).to_numpy(zero_copy_only=False).view("uint64"))))

    rows = written(long.select("letters", "digest", "head").mapInArrow(passing, "letters string, digest binary, head long").select("letters", "digest"))
    total, n = rows.count(), max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    some = sorted(r[0] for r in rows.sample(min(1.0, SAMPLE_A_PART * n / max(total, 1)), seed=7).select(F.substring("letters", 1, BORDER)).collect())
    borders = [some[len(some) * i // n] for i in range(1, n)] if some else []

    def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = pa.array([bisect_right(borders, k[:BORDER]) for k in b.column(0).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([parts, *b.columns], names=["part", "k", "digest"])

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, held = TaskContext.get().partitionId(), None, []
        schema = pa.schema([("kind", pa.string()), ("part", pa.int64()), ("k", pa.string()), ("digest", pa.binary())])
        for b in batches:
            out = []
            for k, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if k != last:
                    if last is None:
                        out.append({"kind": "first", "part": part, "k": k, "digest": d})
                    elif k.startswith(last):
                        out += [{"kind": "hit", "part": part, "k": None, "digest": x} for x in held]
                    last, held = k, []
                held.append(d)
            yield from pa.Table.from_pylist(out, schema=schema).to_batches()
        if last is not None:
            yield from pa.Table.from_pylist([{"kind": "last", "part": part, "k": last, "digest": x} for x in held], schema=schema).to_batches()

    values = rows.mapInArrow(placed, "part int, k string, digest binary").repartitionById(n, "part").select("k", "digest")
    scanned = written(values.sortWithinPartitions("k").mapInArrow(scan, "kind string, part long, k string, digest binary"))
    firsts = scanned.filter("kind = 'first'").select(F.col("part").alias("p2"), F.col("k").alias("k2"))
    # At most one row a partition: the first value of the next partition that has any.
    order = W.orderBy(F.desc("p2"))
    nexts = firsts.withColumn("to", F.lag("p2").over(order)).withColumn("k_to", F.lag("k2").over(order))
    across = scanned.filter("kind = 'last'").join(nexts, F.col("p2") == F.col("part")).filter(F.col("k_to").startswith(F.col("k")) & (F.length("k_to") > F.length("k"))).select("digest")
    return scanned.filter("kind = 'hit'").select("digest").union(across).distinct()


def tail_uses(words: DataFrame, tails: DataFrame) -> DataFrame:
    """Prefix self-join of words: of each of the ``tails`` (tail) its uses n, n_end, n_last and n_longer, the uses of the
    longer words that it begins. ``words`` has word, n, n_end, n_last. Words with digits are no longer words."""
    own = tails.join(words.withColumnRenamed("word", "tail"), "tail", "left").fillna(0, ["n", "n_end", "n_last"])
    begun = words.filter("n > 0 AND NOT word RLIKE '[0-9]'").select("n", F.explode(F.expr("transform(sequence(1, greatest(length(word) - 1, 1)), i -> substring(word, 1, i))")).alias("tail"), "word").filter("tail <> word")
    longer = begun.join(tails, "tail", "left_semi").groupBy("tail").agg(F.sum("n").alias("n_longer"))
    return own.join(longer, "tail", "left").fillna(0, ["n_longer"])


def field_limits(ends: DataFrame) -> DataFrame:
    """(source, unit, size): lengths at which unusually many of ``ends``, the different texts of each source, end.

    In code points, and in UTF-8 bytes (where a limit inside a character leaves
    one to three bytes less).
    """
    open_ = ends.filter("NOT closed OR marked").select("source", "chars", "bytes")
    every = ends.select("source", "chars", "bytes")
    unit = F.explode(F.array(F.struct(F.lit("chars").alias("u"), F.col("chars").alias("s")), F.struct(F.lit("bytes").alias("u"), F.col("bytes").alias("s")))).alias("x")
    hist = every.select("source", unit).groupBy("source", F.col("x.u").alias("unit"), F.col("x.s").alias("size")).agg(F.count(F.lit(1)).alias("c"))
    opened = open_.select("source", unit).groupBy("source", F.col("x.u").alias("unit"), F.col("x.s").alias("size")).agg(F.count(F.lit(1)).alias("c_open")).filter(F.col("c_open") >= SPIKE_LEAST)
    # A limit stands out from the lengths on both sides; a usual length of a source has others like it next to it.
    per = W.partitionBy("source", "unit").orderBy("size")
    far, near = F.sum("c").over(per.rangeBetween(-SPIKE_REACH, SPIKE_REACH)), F.sum("c").over(per.rangeBetween(-3, 3))
    around = hist.withColumn("around", (far - near) / (2 * SPIKE_REACH - 6))
    spikes = around.filter((F.col("c") >= SPIKE_LEAST) & (F.col("c") >= SPIKE_TIMES * F.col("around") + 1))
    cut = spikes.join(opened, [spikes["source"].eqNullSafe(opened["source"]), spikes["unit"] == opened["unit"], spikes["size"] == opened["size"]], "left_semi").filter("c > 0")
    # Bytes and characters go together; the unit with the sharper peak is the one that is limited.
    top = W.partitionBy("source").orderBy(F.desc("c"), "unit", "size").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    sharp = cut.withColumn("top_c", F.first("c").over(top)).withColumn("top_unit", F.first("unit").over(top))
    return sharp.filter((F.col("unit") == F.col("top_unit")) & (F.col("c") >= F.col("top_c") * SPIKE_OF_TOP)).select("source", "unit", "size")


def evidence_columns(open_end: Column) -> list[tuple[str, Column]]:
    """(evidence, condition) over the gathered columns, in order of how directly they show a cut."""
    n, longer, end, last = (F.coalesce(F.col(c), F.lit(0)) for c in ("n", "n_longer", "n_end", "n_last"))
    word = ((n == 0) & (longer > 0) & (last <= LAST_TIMES * longer)) | ((longer >= 5) & (n * 50 <= longer) & (end == 0))
    unsigned = open_end & ~F.col("signed")
    return [
        ("copy", unsigned & F.coalesce(F.col("copied"), F.lit(False))), ("word", open_end & word), ("limit", unsigned & F.coalesce(F.col("hit"), F.lit(False))),
        ("broken", F.col("broken")), ("marked", F.col("marked")), ("unclosed", unsigned & ((F.col("p_closed") >= RULE_SHARE) | (F.col("p_signed") >= RULE_SHARE))),
        ("sentence", unsigned & (n >= ATTESTED) & (end <= n * NEVER_LAST)),
    ]


def truncated(docs: DataFrame, id_col: str, text_col: str, source: str) -> DataFrame:
    """Every text row with ``cut`` (boolean) and the evidence for it.

    Evidence by prefix: 'copy' (a longer copy exists), 'word' (the last word is
    a beginning of words, not a word), 'limit' (open end at a length where the
    source's texts are cut). Evidence by the end alone: 'broken' (a replacement
    character), 'marked' (a mark after an open end), 'unclosed' (no full stop or
    sign-off where the source's texts have one as a rule), 'sentence' (the last
    word cannot end a sentence). Null, empty and blank texts are complete and
    left out. A null source is a source. Output: id, source, cut, evidence (array).
    """
    some = docs.filter(F.col(text_col).isNotNull() & (F.col(text_col) != ""))
    read = written(scan_texts(some.select(text_col).distinct(), text_col), "kind")
    texts = read.filter("kind = 0")
    rows = written(some.select(F.col(id_col).cast("long").alias("row"), F.col(source).alias("source"), F.unhex(F.md5(text_col)).alias("digest")))
    pair = F.concat(F.col("digest"), F.encode(F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("~")), "utf-8"))
    kinds = texts.select("digest", "chars", "bytes", "broken", "marked", "closed", "tail", "prior", "short")
    ends = written(rows.select("source", "digest").distinct().join(kinds, "digest"))

    # A phrase on the last line but one of so many texts is a greeting: at most 2,000 of them, as each has its share of the texts.
    lines = ends.filter("prior IS NOT NULL AND short AND length(prior) <= 40").groupBy("prior").agg(F.countDistinct("digest").alias("n_prior"))
    least = max(5, -(-texts.select("digest").count() // 2000))
    greets = lines.filter(F.col("n_prior") >= least).select("prior", F.lit(True).alias("greets"))
    signed = ends.join(F.broadcast(greets), "prior", "left").withColumn("signed", ~F.col("closed") & F.col("short") & F.coalesce("greets", F.lit(False)) & ~F.col("marked") & ~F.col("broken")).drop("greets")
    name = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("~"))
    share = signed.groupBy(name.alias("__s")).agg(F.avg(F.col("closed").cast("double")).alias("p_closed"), F.avg(F.col("signed").cast("double")).alias("p_signed"))
    ruled = lookup_join(signed.withColumn("__s", name), share, "__s", ["digest"])

    limits = field_limits(ends).groupBy(name.alias("__s")).agg(F.collect_set(F.struct("unit", "size")).alias("limits"))
    at = lookup_join(ruled, written(limits), "__s", ["digest"])
    hit = lambda u, c: F.array_contains("limits", F.struct(F.lit(u).alias("unit"), F.col(c).alias("size")))
    at = at.withColumn("hit", F.coalesce(hit("chars", "chars") | hit("bytes", "bytes"), F.lit(False)))

    words = read.filter("kind = 1").groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_end").alias("n_end"), F.sum("n_last").alias("n_last"))
    tails = texts.filter("tail IS NOT NULL AND NOT closed").select("tail").distinct()
    # A text without a last word, or with a full stop, asks for none; its key is its own, so such texts do not meet in one task.
    asked = at.withColumn("tail", F.when(F.col("tail").isNotNull() & ~F.col("closed"), F.col("tail")).otherwise(F.concat(F.lit(" "), F.hex("digest"))))
    uses = written(tail_uses(words, tails))
    known = salted_join(asked, uses, "tail", hot_keys(ends.filter("NOT closed"), "tail", ends.count()), ["digest"], "left")
    full = known.join(prefix_copies(texts.select("digest", "letters", "head")).withColumn("copied", F.lit(True)), "digest", "left")

    found = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in evidence_columns(~F.col("closed"))]), lambda x: x.isNotNull())
    judged = written(full.select(pair.alias("pair"), found.alias("evidence")))
    own = rows.withColumn("pair", pair)
    out = salted_join(own, judged, "pair", hot_keys(own, "pair", own.count()), ["row"])
    return out.select(F.col("row").alias(id_col), F.col("source").alias(source), (F.size("evidence") > 0).alias("cut"), "evidence")
