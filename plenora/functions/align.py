"""Word-level edit alignment: distances natively, edit operations by Arrow UDFs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plenora.functions.text import let, tokens

#: A hypothesis of more than so many times the reference's words is a runaway.
RUNAWAY = 3
#: Token numbers start in the private-use area, which ends after 6,400.
_FIRST, NATIVE_LIMIT = 0xE000, 6400


def word_distance(ref: Column, hyp: Column) -> Column:
    """Levenshtein distance over tokens, JVM-side.

    Every distinct token becomes one private-use character and the characters'
    distance is taken. Exact while both sides together have at most 6,400
    tokens; null beyond that (``exact_distance`` has no limit). Null counts as ''.
    """
    sides = F.struct(tokens(ref).alias("r"), tokens(hyp).alias("h"))

    def distance(x: Column) -> Column:
        code = lambda arr: F.decode(F.unhex(F.array_join(F.transform(arr, lambda t: F.hex(F.array_position(x["v"], t) + F.lit(_FIRST - 1))), "")), "UTF-16BE")
        return F.when(F.size(x["r"]) + F.size(x["h"]) <= NATIVE_LIMIT, F.levenshtein(code(x["r"]), code(x["h"])))

    return let(let(sides, lambda s: F.struct(s["r"].alias("r"), s["h"].alias("h"), F.array_distinct(F.concat(s["r"], s["h"])).alias("v"))), distance)


def distance(r: list[str], h: list[str]) -> int:
    """Levenshtein distance of two word lists of any length, by bit vectors (Myers; one bit a word of ``r``)."""
    if not r:
        return len(h)
    at: dict[str, int] = {}
    for i, w in enumerate(r):
        at[w] = at.get(w, 0) | 1 << i
    full, top = (1 << len(r)) - 1, 1 << (len(r) - 1)
    more, less, d = full, 0, len(r)
    for w in h:
        eq = at.get(w, 0)
        x = (((eq & more) + more) ^ more) | eq | less
        up, down = less | (full & ~(x | more)), more & x
        d += bool(up & top) - bool(down & top)
        up, down = (up << 1 | 1) & full, down << 1 & full
        v = eq | less
        more, less = down | (full & ~(v | up)), up & v
    return d


def exact_distance(ref: Column, hyp: Column) -> Column:
    """Levenshtein distance over the tokens of two texts of any length; null counts as ''.

    By bit vectors in an Arrow UDF: it takes a step per word of the hypothesis,
    where ``word_distance`` (JVM-side) takes one per pair of words and numbers
    the tokens first, and measured on chunks of thirty words it is the faster too.
    """
    return text_distance(F.coalesce(ref, F.lit("")), F.coalesce(hyp, F.lit("")))


def runaway(ref_n: Column, hyp_n: Column) -> Column:
    """Whether the hypothesis is longer than RUNAWAY times the reference (at least one word)."""
    return hyp_n > RUNAWAY * F.greatest(ref_n, F.lit(1))


def edit_ops(r: list[str], h: list[str]) -> list[tuple[str, int, int]]:
    """Alignment as (op, index in r, index in h), op of '=', 'S', 'D', 'I'.

    Ties are settled in one order, from the end: match or substitution, then
    deletion, then insertion. Whole texts, any length. Equal ends are matched
    first, and of the table only the band is filled that a path of the known
    distance can reach.
    """
    tail = 0
    while tail < min(len(r), len(h)) and r[-1 - tail] == h[-1 - tail]:
        tail += 1
    n, m = len(r) - tail, len(h) - tail
    far = distance(r[:n], h[:m])
    out = [("=", n + k, m + k) for k in reversed(range(tail))]
    width, none = 2 * far + 1, 1 << 30
    back = bytearray((n + 1) * width)
    # Cell (i, j) stands at j - i + far of row i.
    prev = [j - far if j >= far and j - far <= m else none for j in range(width)] + [none]
    for i in range(1, n + 1):
        cur, row, ri = [none] * (width + 1), i * width, r[i - 1]
        for k in range(max(0, far - i), min(width, m - i + far + 1)):
            j = k + i - far
            diag = prev[k] + (ri != h[j - 1]) if j else none
            up, left = prev[k + 1] + 1, cur[k - 1] + 1 if k else none
            if diag <= up and diag <= left:
                cur[k] = diag
            elif up <= left:
                cur[k], back[row + k] = up, 1
            else:
                cur[k], back[row + k] = left, 2
        prev = cur
    i, j = n, m
    while i or j:
        step = back[i * width + j - i + far] if i and j else (1 if i else 2)
        if step == 0:
            i, j = i - 1, j - 1
            out.append(("=" if r[i] == h[j] else "S", i, j))
        elif step == 1:
            i -= 1
            out.append(("D", i, j))
        else:
            j -= 1
            out.append(("I", i, j))
    return out[::-1]


# Types, not DDL strings: these need no session when the module is imported.
COUNTS = T.StructType([T.StructField(n, T.IntegerType()) for n in ("S", "D", "I", "werr", "n_words", "hyp_words")])
OPS = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("op", "ref", "hyp")]))
RESTORED = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_inserted", T.IntegerType())])


@F.pandas_udf(T.IntegerType())
def text_distance(ref, hyp):  # noqa: ANN001, ANN201
    """Levenshtein distance over the blank-separated tokens of two texts."""
    words = lambda t: [w for w in t.split(" ") if w]
    return ref.__class__([distance(words(a), words(b)) for a, b in zip(ref, hyp)], dtype="int32")


@F.pandas_udf(COUNTS)
def edit_counts(ref, hyp):  # noqa: ANN001, ANN201
    """Substitutions, deletions, insertions and their sum for two normalised texts; null counts as ''."""
    import pandas as pd

    rows = []
    for a, b in zip(ref, hyp):
        r, h = (a or "").split() if isinstance(a, str) else [], (b or "").split() if isinstance(b, str) else []
        ops = [o for o, _, _ in edit_ops(r, h)]
        s, d, i = ops.count("S"), ops.count("D"), ops.count("I")
        rows.append((s, d, i, s + d + i, len(r), len(h)))
    return pd.DataFrame(rows, columns=["S", "D", "I", "werr", "n_words", "hyp_words"], dtype="int32")


@F.pandas_udf(OPS)
def edit_stream(ref, hyp):  # noqa: ANN001, ANN201
    """The differences in order: op with the reference's and the hypothesis's word; to be exploded."""
    out = []
    for a, b in zip(ref, hyp):
        r, h = (a or "").split() if isinstance(a, str) else [], (b or "").split() if isinstance(b, str) else []
        out.append([{"op": o, "ref": r[i] if o in "SD" else None, "hyp": h[j] if o in "SI" else None} for o, i, j in edit_ops(r, h) if o != "="])
    return ref.__class__(out)


def char_distance(ref: Column, hyp: Column) -> Column:
    """Levenshtein distance over the characters of two normalised texts, JVM-side; null counts as ''."""
    return F.levenshtein(F.coalesce(ref, F.lit("")), F.coalesce(hyp, F.lit("")))


def word_keys(text: str | None) -> tuple[list[str], list[str]]:
    """Blank-separated words of a raw text and what they are compared by: compatibility form without points and
    punctuation. Words of which nothing is left are their own keys."""
    import re
    import unicodedata

    words = (text or "").split() if isinstance(text, str) else []
    return words, [re.sub(r"[\W_]+", "", re.sub("[\u0591-\u05c7]", "", unicodedata.normalize("NFKC", w))) or w for w in words]


@F.pandas_udf(RESTORED)
def restore_shared(ref, hyp, other):  # noqa: ANN001, ANN201
    """The reference with words put back that both hypotheses have in addition.

    Words are aligned by their keys (``word_keys``) and keep their own spelling.
    Neighbouring differences form one block; of a block with more words in
    ``hyp`` than in ``ref``, up to the excess of those that ``other`` also has
    (each use once) go back, in their order, after the block. The reference's
    own words are never changed. Null counts as ''.
    """
    from collections import Counter

    import pandas as pd

    rows = []
    for a, b, c in zip(ref, hyp, other):
        (r, rk), (h, hk), (_, pool) = word_keys(a), word_keys(b), word_keys(c)
        left, out, n, k, ops = Counter(pool), [], 0, 0, edit_ops(rk, hk)
        while k < len(ops):
            if ops[k][0] == "=":
                out.append(r[ops[k][1]])
                k += 1
                continue
            end = k
            while end < len(ops) and ops[end][0] != "=":
                end += 1
            block = ops[k:end]
            out += [r[i] for o, i, _ in block if o in "SD"]
            theirs = [j for o, _, j in block if o in "SI"]
            excess = len(theirs) - sum(o in "SD" for o, _, _ in block)
            for j in theirs:
                if excess > 0 and left[hk[j]] > 0:
                    left[hk[j]] -= 1
                    excess -= 1
                    out.append(h[j])
                    n += 1
            k = end
        rows.append((" ".join(out), n))
    return pd.DataFrame(rows, columns=["text", "n_inserted"])


def error_content(pairs: DataFrame, arm: str, ref: str, hyp: str) -> DataFrame:
    """Counted differences per arm: arm, kind, reference, hypothesis, count."""
    kinds = F.create_map(*[F.lit(x) for x in ("S", "substitution", "D", "deletion", "I", "insertion")])
    each = pairs.select(arm, F.explode(edit_stream(F.col(ref), F.col(hyp))).alias("e"))
    return each.groupBy(F.col(arm), kinds[F.col("e.op")].alias("kind"), F.col("e.ref").alias("reference"), F.col("e.hyp").alias("hypothesis")).agg(F.count(F.lit(1)).alias("count"))


def shared_insertions(ops_a: DataFrame, key: str) -> DataFrame:
    """Per key the number of insertions that two arms share as multisets.

    ``ops_a`` has key, arm ('A' or 'B'), word. Output: key, shared.
    """
    per = ops_a.groupBy(key, "word").agg(F.count_if(F.col("arm") == "A").alias("a"), F.count_if(F.col("arm") == "B").alias("b"))
    return per.groupBy(key).agg(F.sum(F.least("a", "b")).alias("shared"))


_WORDS = T.ArrayType(T.StringType())


@F.pandas_udf(_WORDS)
def multiset_rest(a, b):  # noqa: ANN001, ANN201
    """The words of ``a`` in order without those that ``b`` has too, each use once; null counts as none."""
    from collections import Counter

    out = []
    for x, y in zip(a, b):
        left, rest = Counter([] if y is None else list(y)), []
        for w in [] if x is None else list(x):
            if left[w] > 0:
                left[w] -= 1
            else:
                rest.append(w)
        out.append(rest)
    return a.__class__(out)
