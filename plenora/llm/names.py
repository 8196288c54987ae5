"""Variant spellings of names, linked to the person they mean by a noisy channel.

A person is seen through a channel that reorders the parts of a name, puts a
nickname or an initial for the given name, adds titles, joins words, and makes
typing errors. Frequent well-formed spellings (given name and surname) are the
candidate canonical forms; every spelling is attached to the candidate of
greatest posterior, the candidate's frequency times the likelihood of what the
channel must have done. Given names and their nicknames are learned from the
data. Candidates come from surname neighbourhoods (one letter deleted), so no
two names are compared that do not share such a key, and everything is done on
distinct forms.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenora.llm.canon import Canoniser
from plenora.operators.skew import hot_keys, salted_join
from plenora.session import written

# Titles and offices that people type before a name.
TITLES = """מר גב גב' גברת אדון ד"ר דר דר' פרופ פרופ' פרופסור ח"כ חה"כ חבר חברת הכנסת השר השרה שר שרה סגן סגנית היו"ר יו"ר היור יור עו"ד עוד הרב רב אלוף מ"מ
mr mrs ms dr prof sir mk minister chair г-н г-жа др депутат""".split()

#: Log-likelihoods of what the channel does.
NICK, INITIAL, GIVEN_TYPO, GLUED, SURNAME_TYPO, MIDDLE, ROSTER = -1.0, -2.0, -4.0, -3.0, -5.0, -1.0, 3.0
#: Log-probability of a letter of a surname that nobody is known to bear.
LETTER = -2.5
#: A surname of one letter has no neighbours, and a name is not taken apart into a given name and less than this.
MIN_TYPO, MIN_GLUED = 2, 4

_ALIAS = re.compile(r"(?<!\w)[\"(]\s*([^\W\d_]{2,20})\s*[\")](?!\w)")
_PART = re.compile(r"[^\W\d_]+(?:[\"'][^\W\d_]+)*[.']?")
_FINALS = str.maketrans("ךםןףץ", "כמנפצ")


def _pieces(text: str, form: Canoniser) -> tuple[list[str], list[str], list[str], list[str]]:
    """Words, initials, aliases and, if there is a comma, the words after it; titles are left out."""
    s = form(text)
    alias = _ALIAS.findall(s)
    s = _ALIAS.sub(" ", s)
    head, comma, tail = s.partition(",")
    lists: list[tuple[list[str], list[str]]] = []
    for part in (tail, head) if comma else (s,):
        words, initials = [], []
        for w in _PART.findall(part):
            bare = w.rstrip(".'")
            if w in TITLES or bare in TITLES or '"' in bare:
                continue
            (initials if len(bare) == 1 else words).append(bare.translate(_FINALS))
        lists.append((words, initials))
    first = lists[0][0] if comma else []
    return [w for ws, _ in lists for w in ws], [i for _, ii in lists for i in ii], [a.translate(_FINALS) for a in alias], first


def _less_one(w: str) -> list[tuple[str, int]]:
    return [(w, -1), *[(w[:i] + w[i + 1 :], i) for i in range(len(w))]]


def _near(a: str, b: str) -> bool:
    """Whether at most one letter is changed, missing, added, or swapped with its neighbour."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        d = [i for i in range(len(a)) if a[i] != b[i]]
        return len(d) == 1 or (len(d) == 2 and d[1] == d[0] + 1 and a[d[0]] == b[d[1]] and a[d[1]] == b[d[0]])
    a, b = sorted((a, b), key=len)
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i:] == b[i + 1 :]


class Lexicon:
    """Known given names and nicknames: form -> given name."""

    def __init__(self, given: list[str], nicks: dict[str, str]):
        self.of = nicks | {g: g for g in given}
        self.near: dict[str, set[str]] = {}
        for w in self.of:
            if len(w) >= 3:
                for k, _ in _less_one(w):
                    self.near.setdefault(k, set()).add(w)

    def readings(self, text: str, form: Canoniser) -> list[tuple[str, str, str, float]]:
        """(kind, given name or initial, surname letters, log-likelihood): what the name spells out, or else what it may stand for."""
        words, initials, alias, first = _pieces(text, form)
        if not words:
            return []
        out: list[tuple[str, str, str, float]] = []
        ends = [(words[0], words[1:])] + ([(words[-1], words[:-1])] if len(words) > 1 and not first else [])
        for w, rest in ends:
            if w in self.of and rest:
                g = self.of[w]
                out.append(("strong", g, "".join(rest), 0.0 if g == w else NICK))
        if out:
            # A second given name may stand between.
            middle = [("weak", g, "".join(rest[1:]), ll + MIDDLE) for (_, g, _, ll), (_, rest) in zip(out, [e for e in ends if e[0] in self.of and e[1]]) if len(rest) > 1 and rest is not words[:-1]]
            return out + [m for m in middle if len(m[2]) >= MIN_GLUED]
        if initials:
            return [("initial", initials[0], "".join(words), INITIAL)]
        known = [self.of[a] for a in alias if a in self.of]
        if known and len(words) > 1:
            rest = words[1:] if _near(words[0], known[0]) or not _near(words[-1], known[0]) else words[:-1]
            return [("strong", known[0], "".join(rest), GIVEN_TYPO)]
        for w, rest in ends:
            for k, _ in _less_one(w):
                for x in self.near.get(k, ()):
                    if rest and len(w) >= 3 and _near(w, x):
                        out.append(("weak", self.of[x], "".join(rest), GIVEN_TYPO))
        # Beginnings and ends are looked up, not searched for, so a large lexicon costs no more than a small one.
        letters = len("".join(words))
        for n in range(3, letters - MIN_GLUED + 1):
            if n <= len(words[0]) and (g := self.of.get(words[0][:n])) is not None:
                out.append(("weak", g, words[0][n:] + "".join(words[1:]), GLUED))
            if n <= len(words[-1]) and (g := self.of.get(words[-1][-n:])) is not None:
                out.append(("weak", g, "".join(words[:-1]) + words[-1][:-n], GLUED))
        return list(dict.fromkeys(out)) or [("none", "", "".join(words), 0.0)]


def learn_lexicon(variants: DataFrame, variant: str, roster: DataFrame | None = None, first_name: str = "first_name") -> Lexicon:
    """Given names from a roster's first names (or, without one, from the first words of names) and
    nicknames from names that carry one in brackets or quotes. Every given name of the roster and every
    nickname of one of them is known, however rare: one attestation is enough at any size of the data.
    The lexicon comes to the driver whole; it grows with the distinct names, not with the rows."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = Canoniser(fold_case=True, strip_marks=True)
        for b in batches:
            given, nick = [], []
            for t in b.column(0).to_pylist():
                words, _, alias, first = _pieces(t, form) if t else ([], [], [], [])
                for a in alias:
                    given.append(words[0] if words else "")
                    nick.append(a)
                if words and not alias:
                    given.append(words[0])
                    nick.append(None)
            yield pa.RecordBatch.from_arrays([pa.array(given, pa.string()), pa.array(nick, pa.string())], names=["given", "nick"])

    said = variants.select(variant).mapInArrow(work, "given string, nick string").filter("given <> ''")
    if roster is not None:
        named, least = roster.select(first_name).mapInArrow(work, "given string, nick string").filter("given <> ''").groupBy("given").count(), 1
    else:
        named, least = said.filter("nick IS NULL").groupBy("given").count(), max(5, int(variants.count() * 0.002))
    known = named.filter(F.col("count") >= least).select("given")
    given = [r[0] for r in known.orderBy("given").collect()]
    # A nickname beside a surname or a misspelt given name says nothing; the given names' own pairs decide.
    pairs = said.filter("nick IS NOT NULL").groupBy("nick", "given").count().join(known, "given", "left_semi")
    best = pairs.groupBy("nick").agg(F.max_by("given", F.struct("count", "given")).alias("given")).orderBy("nick").collect()
    return Lexicon(given, {r["nick"]: r["given"] for r in best})


def surname_neighbours(surnames: DataFrame) -> DataFrame:
    """(s, near) of distinct surnames one error apart: one letter changed, missing, added or swapped with its neighbour."""

    def keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, s = [], []
            for w in b.column(0).to_pylist():
                if len(w) >= MIN_TYPO:
                    for x in {x for x, _ in _less_one(w)}:
                        k.append(x)
                        s.append(w)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.string()), pa.array(s, pa.string())], names=["k", "s"])

    keyed = surnames.select("s").distinct().mapInArrow(keys, "k string, s string")
    pairs = keyed.join(keyed.select("k", F.col("s").alias("near")), "k").filter("s <> near").select("s", "near").distinct()

    # Sharing a shortened form also allows one letter to move far; that is no typing error.
    def errors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([_near(x, y) for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist())], pa.bool_()))

    return pairs.mapInArrow(errors, "s string, near string")


def name_readings(variants: DataFrame, variant: str, lexicon: Lexicon) -> DataFrame:
    """All readings of every distinct spelling: variant, kind, g, s, ll. Null and empty spellings have none."""
    names = {"of": lexicon.of, "near": lexicon.near}

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = Lexicon.__new__(Lexicon)
        lex.__dict__.update(names)
        form = Canoniser(fold_case=True, strip_marks=True)
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for t in b.column(0).to_pylist():
                for reading in lex.readings(t, form):
                    for c, v in zip(cols, (t, *reading)):
                        c.append(v)
            types = (pa.string(), pa.string(), pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["variant", "kind", "g", "s", "ll"])

    spelled = variants.select(F.col(variant).alias("variant")).filter("variant IS NOT NULL AND variant <> ''").distinct()
    return spelled.mapInArrow(work, "variant string, kind string, g string, s string, ll double")


def moved_forms(canon: DataFrame, near: DataFrame) -> DataFrame:
    """(g, s, to): every canonical form with the form whose spelling it is, itself if it is a name of its own.

    ``canon`` has g, s, n (rows), seen (weight of their uses), roster. Forms
    begin as classes of their own. A class of n rows stays one with the
    probability of its letters and of n rows of one new name; or its rows are n
    typing errors among the rows of a neighbouring class of more weight, that
    with a form one error away. Whichever is likelier is taken, and classes grow
    until nothing moves, however long the way. A class with a form on the roster
    is a name of its own.
    """
    edges = written(near.join(canon.select("g", "s"), "s").join(canon.select(F.col("g").alias("e_g"), F.col("s").alias("near")), "near").filter("g = e_g").select("g", "s", "near"))
    ends = written(canon.select("g", "s", F.col("s").alias("to")))
    lgamma, weight = _lgamma, lambda p: F.struct(F.col(f"{p}roster"), F.col(f"{p}n"), F.col(f"{p}seen"), F.col(f"{p}to"))
    n, o_n = F.col("n").cast("double"), F.col("o_n").cast("double")
    own = F.length("to") * LETTER + lgamma(n)
    typo = lgamma(n + o_n) - lgamma(o_n) + n * SURNAME_TYPO
    while True:
        sizes = canon.join(ends, ["g", "s"]).groupBy("g", "to").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"), F.max("roster").alias("roster"))
        other = sizes.select("g", *[F.col(c).alias(f"o_{c}") for c in ("to", "n", "seen", "roster")])
        met = edges.join(ends, ["g", "s"]).join(ends.select("g", F.col("s").alias("near"), F.col("to").alias("o_to")), ["g", "near"]).filter("to <> o_to").select("g", "to", "o_to").distinct()
        pairs = met.join(sizes.filter("NOT roster"), ["g", "to"]).join(other, ["g", "o_to"]).filter((weight("o_") > weight("")) & (typo > own))
        step = written(pairs.groupBy("g", "to").agg(F.max_by("o_to", weight("o_")).alias("next")))
        if step.isEmpty():
            return ends
        # Moves go up in weight; each doubling follows twice as many of them.
        while True:
            far = step.join(step.select("g", F.col("to").alias("next"), F.col("next").alias("then")), ["g", "next"], "left")
            if far.filter("then IS NOT NULL").isEmpty():
                break
            step = written(far.select("g", "to", F.coalesce("then", "next").alias("next")))
        ends = written(ends.join(step, ["g", "to"], "left").select("g", "s", F.coalesce("next", "to").alias("to")))


def _lgamma(x):  # noqa: ANN001, ANN202
    """log of the gamma function for x >= 1, by Stirling's series at x + 6: exact to 1e-9."""
    z = x + 6
    rest = F.log(x) + F.log(x + 1) + F.log(x + 2) + F.log(x + 3) + F.log(x + 4) + F.log(x + 5)
    return (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z) - rest


def attribute(variants: DataFrame, row_id: str, variant: str, person: str, uses: str | None, lexicon: Lexicon) -> DataFrame:
    """(row, person, entity): each row attached to its candidate of greatest posterior.

    A canonical form is a (given name, surname) pair that some row spells out;
    its weight are its rows, each with one more for every doubling of its uses
    (``uses`` column; null and less than one count as one), and whether a
    resolved row bears it. A spelled-out form stays
    or moves by ``moved_forms``. Initials and weak readings go to the best form
    that they can stand for; what stands for none is an entity of its own. Rows
    with a null id are kept as rows, a null person is 0; null and empty
    spellings, and those without a word, are left out.
    """
    # Whole hundredths, so that sums do not depend on their order. One spelling used a thousand times is still one typing.
    seen = F.floor(100 + 100 * F.log2(F.greatest(F.coalesce(F.col(uses).cast("double"), F.lit(1.0)), F.lit(1.0)))).cast("long") if uses else F.lit(100).cast("long")
    rows = written(variants.select(F.col(row_id).cast("long").alias("row"), F.coalesce(F.col(person).cast("long"), F.lit(0)).alias("person"), F.col(variant).alias("variant"), seen.alias("uses")).filter("variant IS NOT NULL AND variant <> ''"))
    readings = written(name_readings(rows, "variant", lexicon))
    per = rows.groupBy("variant").agg(F.countDistinct("row").alias("n"), F.sum("uses").alias("seen"), (F.max("person") > 0).alias("roster"))
    strong = readings.filter("kind = 'strong'")
    canon = written(strong.join(per, "variant").groupBy("g", "s").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"), F.max("roster").alias("roster")))
    near = written(surname_neighbours(readings.select("s")))
    ends = moved_forms(canon, near)
    total = canon.join(ends, ["g", "s"]).groupBy("g", F.col("to").alias("t_s")).agg(F.sum("seen").alias("seen"), F.max("roster").alias("roster"))
    prior = F.log(F.col("seen") / 100.0) + F.when(F.col("roster"), ROSTER).otherwise(0.0)
    place = written(ends.withColumnRenamed("to", "t_s").join(total.select("g", "t_s", prior.alias("prior")), ["g", "t_s"]).select(F.col("g").alias("t_g"), "s", F.col("t_s").alias("to"), "prior"))

    # Surnames that a weak reading may mean: its own or one error away.
    weak = readings.filter("kind IN ('weak', 'initial')")
    reach = near.select("s", "near", F.lit(SURNAME_TYPO).alias("sl"))
    wide = weak.select("*", F.col("s").alias("near"), F.lit(0.0).alias("sl")).unionByName(weak.join(reach, "s"))
    target = place.withColumnRenamed("s", "near")
    first = F.when(F.col("kind") == "weak", F.col("g") == F.col("t_g")).otherwise(F.col("g") == F.substring("t_g", 1, 1))
    loose = wide.join(target, "near").filter(first)
    sure = strong.withColumn("sl", F.lit(0.0)).join(place, (F.col("g") == F.col("t_g")) & (strong["s"] == place["s"])).drop(place["s"])
    cols = ["variant", "t_g", "to", (F.col("ll") + F.col("sl") + F.col("prior")).alias("score")]
    best = sure.select(*cols).unionByName(loose.select(*cols)).groupBy("variant").agg(F.max_by(F.concat_ws("|", "t_g", "to"), F.struct("score", "t_g", "to")).alias("entity"))
    alone = readings.groupBy("variant").agg(F.min(F.concat_ws("|", F.lit("~"), "g", "s")).alias("alone"))
    named = alone.join(best, "variant", "left").select("variant", F.coalesce("entity", "alone").alias("entity"))
    return salted_join(rows.select("row", "person", "variant"), named, "variant", hot_keys(rows, "variant", rows.count()), ["row"]).select("row", "person", "entity").distinct()


def linked_pairs(attributed: DataFrame, hot_rows: int = 300, ways: int = 64) -> DataFrame:
    """(a, b), a < b: rows of one entity of which at least one has no person.

    Unresolved rows meet all rows of their entity, so no pair of two resolved
    rows is ever formed. The entities of ``hot_rows`` rows and a thousandth of
    all rows are dealt out to ``ways`` tasks by row. Rows with a null id are in no pair.
    """
    own = written(attributed.filter("row IS NOT NULL"))
    left = own.select("entity", F.col("row").alias("x"), F.col("person").alias("px"))
    right = own.filter("person = 0").select("entity", F.col("row").alias("y"))
    met = salted_join(left, right, "entity", hot_keys(own, "entity", own.count(), least=hot_rows), ["x"], ways=ways)
    return met.filter("y < x OR (y > x AND px > 0)").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
