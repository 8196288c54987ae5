"""Entity resolution by strict keys, validity intervals and decision ladders."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plenora.functions.text import age_years, tokens
from plenora.session import written

MAX_AGE = 95


def active_on(dates: DataFrame, stints: DataFrame, date: str, key: str, start: str = "start", end: str = "end", keys: Sequence[str] = ()) -> DataFrame:
    """Pairs (date row, stint) with start <= date <= end, an open end counting as for ever.

    A bare range condition would be a nested-loop join. Stints list the years
    they touch (an open end reaches to the last date asked for), dates have one,
    and the join is an equality on (keys, year) with the range as residual.
    """
    last = dates.agg(F.max(F.year(date)).alias("__last"))
    s = stints.filter(F.col(start).isNotNull()).crossJoin(F.broadcast(last))
    to = F.least(F.coalesce(F.year(end), F.col("__last")), F.col("__last"))
    s = s.filter(F.year(start) <= to).withColumn("__year", F.explode(F.sequence(F.year(start), to))).select(*keys, key, F.col(start).alias("__from"), F.col(end).alias("__to"), "__year").distinct()
    d = dates.withColumn("__year", F.year(date))
    ok = (F.col("__from") <= F.col(date)) & (F.col("__to").isNull() | (F.col("__to") >= F.col(date)))
    return d.join(s, [*keys, "__year"]).filter(ok).drop("__year", "__from", "__to")


def overlapping_homonyms(variants: DataFrame, stints: DataFrame, person: str, variant: str, start: str = "start", end: str = "end") -> DataFrame:
    """(variant, a, b), a < b: different persons of one spelling whose validity overlaps.

    Equality on the spelling first, the overlap as residual; spans per person
    are reduced to distinct rows before the join.
    """
    v = variants.select(person, variant).distinct().join(stints.select(person, start, end).distinct(), person)
    a = v.select(variant, F.col(person).alias("a"), F.col(start).alias("a_s"), F.col(end).alias("a_e"))
    b = v.select(variant, F.col(person).alias("b"), F.col(start).alias("b_s"), F.col(end).alias("b_e"))
    meets = (F.col("a_e").isNull() | (F.col("a_e") >= F.col("b_s"))) & (F.col("b_e").isNull() | (F.col("b_e") >= F.col("a_s")))
    return a.join(b, variant).filter((F.col("a") < F.col("b")) & meets).select(variant, "a", "b").distinct()


def name_forms(clean: Column) -> Column:
    """Forms of a clean name in the order they are tried: all of it, then its last 2, 3 and 4 tokens if it is longer."""
    t = tokens(clean)
    suffix = [F.when(F.size(t) > n, F.struct(F.lit(k).alias("ix"), F.lit("suffix").alias("how"), F.array_join(F.slice(t, -n, n), " ").alias("form"))) for k, n in ((1, 2), (2, 3), (3, 4))]
    return F.filter(F.array(F.struct(F.lit(0).alias("ix"), F.lit("exact").alias("how"), F.array_join(t, " ").alias("form")), *suffix), lambda x: x.isNotNull() & (x["form"] != ""))


def unique_match(names: DataFrame, key: str, clean: str, variants: DataFrame, person: str, variant: str) -> DataFrame:
    """(key, person, how): the first form of the name that any spelling equals decides; one person is a match
    ('exact' or 'suffix'), several are 'ambiguous', no form is no row's match (how null).

    Every distinct clean name is matched once and joined back.
    """
    asked = names.select(clean).filter(F.col(clean).isNotNull() & (F.col(clean) != "")).distinct()
    forms = asked.select(clean, F.explode(name_forms(F.col(clean))).alias("f"))
    hit = forms.join(variants.select(F.col(person).alias("__p"), F.col(variant).alias("__v")).distinct(), F.col("f.form") == F.col("__v"))
    per = hit.groupBy(clean, F.col("f.ix").alias("ix"), F.col("f.how").alias("how")).agg(F.countDistinct("__p").alias("n"), F.min("__p").alias("p"))
    first = per.groupBy(clean).agg(F.min_by(F.struct("how", "n", "p"), "ix").alias("x"))
    one = first.select(F.col(clean).alias("__c"), F.when(F.col("x.n") == 1, F.col("x.p")).alias(person), F.when(F.col("x.n") == 1, F.col("x.how")).otherwise("ambiguous").alias("how"))
    return names.join(one, F.col(clean) == F.col("__c"), "left").select(*names.columns, person, "how")


def seated_match(rows: DataFrame, clean: str, date: str, variants: DataFrame, person: str, variant: str, stints: DataFrame) -> DataFrame:
    """``rows`` with (person, how): as ``unique_match``, but only persons whose term covers the row's date are candidates.

    Distinct (name, date) pairs are matched once; the first form that any seated
    person's spelling equals decides. Rows without a name or date match nobody.
    """
    asked = rows.select(F.col(clean).alias("__c"), F.col(date).alias("__d")).filter("__c IS NOT NULL AND __c <> '' AND __d IS NOT NULL").distinct()
    forms = asked.select("__c", "__d", F.explode(name_forms(F.col("__c"))).alias("f"))
    hit = forms.join(variants.select(F.col(person).alias("__p"), F.col(variant).alias("__v")).distinct(), F.col("f.form") == F.col("__v"))
    seated = hit.join(stints.select(F.col(person).alias("__q"), F.col("start").alias("__s"), F.col("end").alias("__e")), F.col("__p") == F.col("__q")).filter("__s <= __d AND (__e IS NULL OR __e >= __d)")
    per = seated.groupBy("__c", "__d", F.col("f.ix").alias("ix"), F.col("f.how").alias("how")).agg(F.countDistinct("__p").alias("n"), F.min("__p").alias("p"))
    first = per.groupBy("__c", "__d").agg(F.min_by(F.struct("how", "n", "p"), "ix").alias("x"))
    one = first.select("__c", "__d", F.when(F.col("x.n") == 1, F.col("x.p")).alias(person), F.when(F.col("x.n") == 1, F.col("x.how")).otherwise("ambiguous").alias("how"))
    return rows.join(one, (F.col(clean) == F.col("__c")) & (F.col(date) == F.col("__d")), "left").drop("__c", "__d")


def verified_sessions(segments: DataFrame, session: str, ok: Column, least: float = 0.90) -> DataFrame:
    """(session, share, accepted): share of a session's segments whose text stands where it should; sessions below ``least`` are rejected."""
    per = segments.groupBy(session).agg(F.avg(F.coalesce(ok, F.lit(False)).cast("double")).alias("share"))
    return per.withColumn("accepted", F.col("share") >= least)


def tokens_agree(a: Column, b: Column) -> Column:
    """Whether two token strings agree: equal token sets, or the smaller one, of at least two tokens, within the other.
    Null or empty never agrees."""
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    xin, yin = F.size(F.array_except(x, y)) == 0, F.size(F.array_except(y, x)) == 0
    return (F.size(x) > 0) & (F.size(y) > 0) & ((xin & yin) | (xin & (F.size(x) >= 2)) | (yin & (F.size(y) >= 2)))


def implausible(on: Column, born: Column, died: Column) -> Column:
    """'deceased' if dead before the date, 'implausible_age' if over 95, else null."""
    return F.when(died < on, "deceased").when(age_years(on, born) > MAX_AGE, "implausible_age")


def ladder(rungs: Sequence[tuple[Column, str, str | None]], default: tuple[str, str | None]) -> Column:
    """struct<label, reason> of the first rung whose condition holds (null counts as false)."""
    make = lambda lab, why: F.struct(F.lit(lab).alias("label"), F.lit(why).cast("string").alias("reason"))
    out = make(*default)
    for cond, lab, why in reversed(rungs):
        out = F.when(F.coalesce(cond, F.lit(False)), make(lab, why)).otherwise(out)
    return out


def label_with_gold(offset_ok: Column, gold_id: Column, gold_valid: Column, garbage: Column, known: Column, names_agree: Column, seated: Column, gate: Column) -> Column:
    """Label and reason of a row that has an editor's gold speaker; the order of the rungs matters."""
    numeric = F.coalesce(gold_id.rlike(r"^\d+$"), F.lit(False))
    return ladder(
        [
            (~F.coalesce(offset_ok, F.lit(False)), "unresolved", "bad_offset"), (gold_id.isNull(), "unresolved", "no_gold"), (~numeric | ~F.coalesce(gold_valid, F.lit(False)), "non_mk", "gold_guest"),
            (garbage, "unresolved", "raw_garbage"), (~F.coalesce(known, F.lit(False)), "unresolved", "unknown_id"), (~F.coalesce(names_agree, F.lit(False)), "unresolved", "name_disagree"), (seated, "mk", None),
            (gate == "deceased", "unresolved", "deceased"), (gate == "implausible_age", "unresolved", "implausible_age"),
        ],
        ("former_mk", None),
    )


def label_by_name(offset_ok: Column, garbage: Column, how: Column, alias_usable: Column, alias_seated: Column, et_conflict: Column) -> Column:
    """Label and reason of a row that only has a name: a unique match, else a usable alias of someone seated, minus editor vetoes."""
    matched = how.isin("exact", "suffix") | (F.coalesce(alias_usable, F.lit(False)) & F.coalesce(alias_seated, F.lit(False)))
    return ladder(
        [
            (~F.coalesce(offset_ok, F.lit(False)), "unresolved", "bad_offset"), (garbage, "unresolved", "raw_garbage"), (how == "ambiguous", "unresolved", "ambiguous"),
            (~F.coalesce(matched, F.lit(False)), "unresolved", "no_match"), (et_conflict, "unresolved", "et_conflict"),
        ],
        ("mk", None),
    )


def demote(df: DataFrame, mask: Column, reason: str, cleared: Sequence[str], rename: Column | None = None) -> DataFrame:
    """Rows under the mask become unresolved: id 0, the reason set, ``cleared`` columns null, the file name re-made."""
    hit = F.coalesce(mask, F.lit(False))
    cols = {"label": F.when(hit, "unresolved").otherwise(F.col("label")), "reason": F.when(hit, reason).otherwise(F.col("reason")), "speaker_id": F.when(hit, F.lit(0).cast("long")).otherwise(F.col("speaker_id"))}
    cols |= {c: F.when(~hit, F.col(c)) for c in cleared}
    if rename is not None:
        cols["filename"] = F.when(hit, rename).otherwise(F.col("filename"))
    return df.withColumns(cols)


def attach_demographics(rows: DataFrame, primary: DataFrame, fallback: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Attributes from the primary roster or, where it lacks the person, all of them from the fallback one.
    Of several rows of a person the greatest values together count."""
    p = primary.groupBy(F.col(key).alias("__p")).agg(F.max(F.struct(*cols)).alias("__a"))
    f = fallback.groupBy(F.col(key).alias("__f")).agg(F.max(F.struct(*cols)).alias("__b"))
    both = rows.join(p, F.col(key) == F.col("__p"), "left").join(f, F.col(key) == F.col("__f"), "left")
    return both.withColumn("__x", F.coalesce("__a", "__b")).select(*rows.columns, *[F.col("__x")[c].alias(c) for c in cols])


def route_sessions(manifest: DataFrame) -> DataFrame:
    """``complete`` (all six files present) and ``path``: 'A' with a gold shard, 'B' without, '' if incomplete."""
    files = ["has_audio", "has_refined", "has_map", "has_speakers", "has_segments", "has_metadata"]
    full = F.lit(True)
    for c in files:
        full = full & F.coalesce(F.col(c), F.lit(False))
    return manifest.withColumn("is_complete", full).withColumn("path", F.when(full & F.coalesce("has_shard", F.lit(False)), "A").when(full, "B").otherwise(""))


def judge_holdout(gold: Column, guess: Column, gold_label: Column, in_corpus: Column) -> Column:
    """Verdict on a name-only decision against the gold one; ids 0 or null mean nobody."""
    g, p = F.coalesce(gold, F.lit(0)), F.coalesce(guess, F.lit(0))
    return (
        F.when((p > 0) & (p == g), "correct").when((p > 0) & (g > 0), "cross_person").when((p > 0) & (gold_label == "non_mk"), F.when(F.coalesce(in_corpus, F.lit(True)), "guest_as_mk").otherwise("corpus_missed"))
        .when(p > 0, "unjudged").when(g > 0, "missed").otherwise("both_unassigned")
    )


def unit_sums(vectors: DataFrame, label: str, vec: str) -> DataFrame:
    """(label, c): the unit mean of the unit vectors of each label. Summed per batch first; null and zero vectors are left out."""
    kind = vectors.schema[label].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, ok = _units(b.column(1))
            enc = b.column(0).dictionary_encode()
            code = enc.indices.to_numpy(zero_copy_only=False)
            if ok.any():
                sums = [x[ok & (code == k)].sum(0) for k in range(len(enc.dictionary))]
                yield pa.RecordBatch.from_arrays([enc.dictionary, pa.array([s.tolist() for s in sums], pa.list_(pa.float64()))], names=[label, "s"])

    parts = vectors.filter(F.col(label).isNotNull() & F.col(vec).isNotNull()).select(label, vec).mapInArrow(work, f"`{label}` {kind}, s array<double>")
    dims = parts.select(label, F.posexplode("s").alias("i", "x")).groupBy(label, "i").agg(F.sum("x").alias("x"))
    arr = dims.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c"))
    size = F.sqrt(F.aggregate("c", F.lit(0.0), lambda a, x: a + x * x))
    return arr.withColumn("__s", size).filter("__s > 0").select(label, F.transform("c", lambda x: x / F.col("__s")).alias("c"))


def _units(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to length one, and which of them have a length; all rows have the first one's number of values."""
    rows = col.to_pylist()
    dim = max((len(r) for r in rows if r), default=0)
    x = np.array([r if r is not None and len(r) == dim else [0.0] * dim for r in rows], float).reshape(len(rows), dim)
    norm = np.sqrt((x * x).sum(1))
    return x / np.where(norm > 0, norm, 1.0)[:, None], norm > 0


def contamination(vectors: DataFrame, key: str, label: str, vec: str, keep: float = 0.75, block: int = 4096) -> DataFrame:
    """Per vector its cosine to its own label's trimmed centroid, to the nearest other one, and the margin.

    A centroid is the unit mean of unit vectors; it is taken again over the
    tightest ``keep`` of its members (at least one). Vectors are multiplied with
    the centroids of ``block`` labels at a time, so what is sent to the tasks has
    a bound whatever the number of labels. Null or zero vectors and null labels
    are left out.
    """
    some = vectors.filter(F.col(vec).isNotNull() & F.col(label).isNotNull()).select(key, label, F.col(vec).cast("array<double>").alias("__v"))
    near = written(_cosines(some, key, label, unit_sums(some, label, "__v"), block).select(key, label, "own"))
    w = W.partitionBy(label)
    tight = near.withColumn("__k", F.row_number().over(w.orderBy(F.desc("own"), key))).withColumn("__n", F.count(F.lit(1)).over(w)).filter(F.col("__k") <= F.greatest(F.bround(F.col("__n") * keep), F.lit(1)))
    cents = unit_sums(some.join(tight.select(key, label), [key, label], "left_semi"), label, "__v")
    return _cosines(some, key, label, cents, block).withColumn("margin", F.col("own") - F.col("nearest_other"))


def _cosines(vectors: DataFrame, key: str, label: str, cents: DataFrame, block: int) -> DataFrame:
    """(key, label, own, nearest_other) by matrix products with the centroids, block by block."""
    cents = written(cents)
    n = max(1, -(-cents.count() // block))
    kinds = [vectors.schema[c].dataType.simpleString() for c in (key, label)]
    found = None
    for k in range(n):
        part = cents.filter(F.pmod(F.xxhash64(label), F.lit(n)) == k).orderBy(label).toArrow()
        names, matrix = part.column(0).to_pylist(), np.array(part.column(1).to_pylist(), float)

        def work(batches: Iterator[pa.RecordBatch], names=names, matrix=matrix) -> Iterator[pa.RecordBatch]:
            place = {x: i for i, x in enumerate(names)}
            for b in batches:
                x, ok = _units(b.column(2))
                if not ok.any() or not names:
                    continue
                rows = np.flatnonzero(ok)
                cos = x[rows] @ matrix.T
                at = np.array([place.get(v, -1) for v in b.column(1).to_pylist()])[rows]
                mine = at >= 0
                own = np.where(mine, cos[np.arange(len(rows)), at], np.nan)
                cos[np.flatnonzero(mine), at[mine]] = -np.inf
                best = cos.max(1)
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(own, mask=~mine), pa.array(best, mask=np.isinf(best))], names=[key, label, "own", "nearest_other"])

        one = vectors.select(key, label, "__v").mapInArrow(work, f"`{key}` {kinds[0]}, `{label}` {kinds[1]}, own double, nearest_other double")
        found = one if found is None else found.unionByName(one)
    return found if n == 1 else found.groupBy(key, label).agg(F.max("own").alias("own"), F.max("nearest_other").alias("nearest_other"))


def place_texts(df: DataFrame, key: str, text: str, pieces: str) -> DataFrame:
    """Places of an ordered array of verbatim pieces in a text: from behind the last piece, else from the
    start, else none. One row per piece: key, ix, piece, at (0-based, null if absent).

    A fold over the array; a backward hit moves the cursor as a forward one does.
    """
    state = "struct<cursor: int, out: array<struct<ix: int, piece: string, at: int>>>"
    zero = F.expr(f"cast(named_struct('cursor', 0, 'out', array()) as {state})")

    def step(acc: Column, p: Column) -> Column:
        fwd = F.locate_at(p, F.col(text), acc["cursor"]) if hasattr(F, "locate_at") else F.call_function("locate", p, F.col(text), acc["cursor"] + 1)
        back = F.call_function("locate", p, F.col(text), F.lit(1))
        at = F.when(F.length(p) == 0, F.lit(0)).when(fwd > 0, fwd).otherwise(back)
        placed = F.struct(F.size(acc["out"]).alias("ix"), p.alias("piece"), F.when(at > 0, at - 1).alias("at"))
        return F.struct(F.when(at > 0, at - 1 + F.length(p)).otherwise(acc["cursor"]).alias("cursor"), F.concat(acc["out"], F.array(placed)).alias("out")).cast(state)

    return df.select(key, F.explode(F.aggregate(pieces, zero, step, lambda a: a["out"])).alias("x")).select(key, "x.ix", "x.piece", "x.at")
