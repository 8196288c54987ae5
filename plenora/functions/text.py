"""Text and identifier functions as Column expressions (JVM-side unless noted).

Java's ``\\w`` and ``\\s`` are ASCII only; patterns here use ``(?U)`` or explicit
classes. Unless a docstring says otherwise, null in gives null out.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Whole titles that may lead a speaker's name, a chair's and others.
CHAIR_TITLES = [
    'היו"ר', "היו״ר", 'יו"ר', "יו״ר", 'מ"מ היו"ר', "מ״מ היו״ר", 'ממלא מקום היו"ר', 'ממלאת מקום היו"ר', "היושב ראש", "היושבת ראש", "היושב-ראש", "היושבת-ראש",
]
OTHER_TITLES = [
    "היו'ר", 'ח"כ', 'חה"כ', "ח״כ", "חה״כ", "חבר הכנסת", "חברת הכנסת", "ראש הממשלה", "סגן השר", "סגנית השרה", "סגנית השר", "סגני השר", "סגני השרה", "השר", "השרה", "שר", "שרת",
    "מזכיר הכנסת", "מזכירת הכנסת", "מנהל הועדה", "מנהלת הועדה", "מנהל ועדה", "מנהלת ועדה", "מנהל הוועדה", "מנהלת הוועדה", "היועץ המשפטי", "היועצת המשפטית", "היועצ המשפטי", "היועצת המשפטי", "היועצ המשפטית",
    "יועץ משפטי", "יועצת משפטית", "יועצ משפטי", "יועצת משפטי", "יועצ משפטית",
]
#: A title at the start of a line, followed by a blank.
TITLE = rf"^(?:{'|'.join(CHAIR_TITLES + OTHER_TITLES)})\s+"
CHAIR = rf"^\s*(?:{'|'.join(CHAIR_TITLES)})\s"
MAX_NAME_CHARS, MAX_NAME_TOKENS = 60, 8


def normalize_text(col: Column) -> Column:
    """Comparable text: points dropped, quotes, dashes and other punctuation to blanks, blanks collapsed; null gives ''.

    Quotes become a blank, never nothing, so that an abbreviation stays two
    tokens. Input is taken to be in compatibility form already (see ``nfkc``).
    """
    bare = F.regexp_replace(F.coalesce(col, F.lit("")), "[\\u0591-\\u05C7]", "")
    return F.trim(F.regexp_replace(bare, "[^\\p{L}\\p{M}\\p{N}_]+|_+", " "))


@F.pandas_udf(T.StringType())
def nfkc(values):  # noqa: ANN001, ANN201
    """Compatibility composition (an Arrow UDF: there is no builtin); once per distinct value of a batch."""
    import unicodedata

    known = {v: unicodedata.normalize("NFKC", v) for v in values.dropna().unique()}
    return values.map(known, na_action="ignore")


def let(value: Column, body):  # noqa: ANN001, ANN201
    """``body`` of a value that is evaluated once: an expression used inside a lambda is otherwise evaluated per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tokens(col: Column) -> Column:
    """Array of blank-separated tokens; '' and null give an empty array (a plain split would give one token)."""
    s = F.coalesce(col, F.lit(""))
    return F.filter(F.split(s, " "), lambda t: t != "")


def token_count(col: Column) -> Column:
    """Number of tokens, 0 for '' and null."""
    return F.size(tokens(col))


def collapse_blanks(col: Column) -> Column:
    """Runs of any white space to one blank, ends trimmed."""
    return F.trim(F.regexp_replace(col, "(?U)\\s+", " "))


def drop_parentheses(col: Column) -> Column:
    """Text without its parenthesised parts and the blanks before them."""
    return F.regexp_replace(col, "(?U)\\s*\\([^)]*\\)", "")


def is_garbage_name(raw: Column) -> Column:
    """Whether a raw speaker line cannot be a name: null or blank, with a colon or a digit, or, once
    parentheses are gone, empty, over 60 characters or over 8 tokens. Never null."""
    bare = F.trim(drop_parentheses(raw))
    bad = (F.trim(raw) == "") | raw.contains(":") | raw.rlike("(?U)\\d") | (bare == "") | (F.length(bare) > MAX_NAME_CHARS) | (token_count(collapse_blanks(bare)) > MAX_NAME_TOKENS)
    return F.coalesce(bad, F.lit(True))


def clean_name(raw: Column) -> Column:
    """Comparable name: no parentheses, one leading title removed, normalised; null for garbage and for nothing left."""
    bare = F.trim(F.regexp_replace(raw, "\\s*\\([^)]*\\)", " "))
    return F.when(~is_garbage_name(raw), F.nullif(normalize_text(F.regexp_replace(bare, TITLE, "")), F.lit("")))


def reverse_tokens(col: Column) -> Column:
    """The blank-separated tokens in reverse order."""
    return F.array_join(F.reverse(tokens(col)), " ")


def spelling_variants(first: Column, last: Column, full: Column) -> Column:
    """Sorted distinct accepted spellings of a person, normalised: both orders of first and last name and of
    the full name and, where a name carries '(nick)', the name without it and with the nickname in place of
    the word before it. Empty spellings are dropped."""
    pair, swapped = F.concat_ws(" ", first, last), F.concat_ws(" ", last, first)
    forms: list[Column] = [pair, swapped]
    for name in (full, pair):
        nick = F.nullif(F.trim(F.regexp_extract(name, r"^(.*?)\s*\((.+?)\)\s*(.*)$", 2)), F.lit(""))
        before = tokens(collapse_blanks(F.regexp_extract(name, r"^(.*?)\s*\((.+?)\)\s*(.*)$", 1)))
        after = tokens(collapse_blanks(F.regexp_extract(name, r"^(.*?)\s*\((.+?)\)\s*(.*)$", 3)))
        kept = F.greatest(F.size(before) - 1, F.lit(0))
        # Without a word before the brackets the nickname replaces the first one after them.
        with_nick = F.concat(F.slice(before, F.lit(1), kept), F.array(nick), F.when(F.size(before) > 0, after).otherwise(F.slice(after, F.lit(2), F.greatest(F.size(after) - 1, F.lit(0)))))
        base = F.concat(before, after)
        for words in (F.when(nick.isNotNull(), base), F.when(nick.isNotNull() & (F.size(base) > 0), with_nick), F.when(nick.isNull(), tokens(collapse_blanks(name)))):
            forms += [F.array_join(words, " "), F.array_join(F.reverse(words), " ")]
    made = F.transform(F.array(*[F.coalesce(x, F.lit("")) for x in forms]), normalize_text)
    return F.array_sort(F.array_distinct(F.filter(made, lambda x: x != "")))


def is_chairman(raw: Column) -> Column:
    """Whether a raw speaker line starts with a chair's title; false for null."""
    return F.coalesce(raw, F.lit("")).rlike(CHAIR)


def has_script(col: Column, lo: str = "א", hi: str = "ת") -> Column:
    """Whether a character of the range occurs; false for null."""
    return F.coalesce(col.rlike(f"[{lo}-{hi}]"), F.lit(False))


def has_digit(col: Column) -> Column:
    """Whether a digit occurs; false for null."""
    return F.coalesce(col.rlike("(?U)\\d"), F.lit(False))


def to_ms(seconds: Column) -> Column:
    """Seconds to whole ms, halves to even as in the source data's rounding."""
    return F.bround(seconds * 1000).cast("long")


def span_id(speaker: Column, session: Column, start_s: Column, end_s: Column, extension: str = "flac") -> Column:
    """``speaker_session_startms_endms.ext``."""
    return F.concat(F.concat_ws("_", speaker.cast("long").cast("string"), session.cast("long").cast("string"), to_ms(start_s).cast("string"), to_ms(end_s).cast("string")), F.lit(f".{extension}"))


def parse_span_id(col: Column) -> Column:
    """Inverse of ``span_id``: struct<speaker_id, session, start_s, end_s>; null fields where it does not parse."""
    part = lambda i: F.nullif(F.regexp_extract(col, r"(?:^|/)(-?\d+)_(\d+)_(\d+)_(\d+)\.\w+$", i), F.lit("")).try_cast("bigint")
    return F.struct(part(1).alias("speaker_id"), part(2).alias("session"), (part(3) / 1000).alias("start_s"), (part(4) / 1000).alias("end_s"))


def protocol_session(file_name: Column) -> Column:
    """Session number of a protocol file name ``<digits>_ptv_<digits>.doc[x]``, any case; null otherwise."""
    return F.nullif(F.regexp_extract(file_name, r"(?i)^(\d+)_ptv_\d+\.docx?$", 1), F.lit("")).try_cast("bigint")


def sortable_key(date: Column, session: Column) -> Column:
    """``YYYY-MM-DD_<session>``. Compares as text: sort by (date, session) where ids differ in length."""
    return F.concat_ws("_", date.cast("string"), session.cast("string"))


def swap_extension(col: Column, old: str, new: str) -> Column:
    """File name with the extension ``old`` replaced by ``new``."""
    return F.regexp_replace(col, rf"\.{old}$", f".{new}")


def time_token(seconds: Column, grid: float = 0.02, top: float = 30.0) -> Column:
    """``<|s.ss|>`` on the grid; raises for times outside [0, top]."""
    snapped = F.bround(seconds / grid) * grid
    token = F.format_string("<|%.2f|>", snapped)
    return F.when(seconds.isNull(), F.lit(None).cast("string")).when((snapped < 0) | (snapped > top), F.raise_error(F.concat(F.lit("time out of range: "), seconds.cast("string"))).cast("string")).otherwise(token)


def name_field(col: Column, key: str) -> Column:
    """Value after ``key`` in a composite recipe name such as ``lr0.0001_r8_d0.1``; null if absent."""
    return F.nullif(F.regexp_extract(col, rf"(?:^|_){key}([0-9.eE+-]+)(?:_|$)", 1), F.lit(""))


@F.pandas_udf(T.DoubleType())
def compression_ratio(values):  # noqa: ANN001, ANN201
    """UTF-8 bytes over zlib-compressed bytes, 0 for '' and null (an Arrow UDF: there is no builtin)."""
    raw = [v.encode() if isinstance(v, str) else b"" for v in values]
    return values.__class__([len(b) / len(zlib.compress(b)) if b else 0.0 for b in raw], dtype="float64")


def is_transient_error(col: Column) -> Column:
    """Whether an error message is worth a retry (time-outs, connection trouble, throttling, 5xx); false for null."""
    return F.coalesce(col.rlike(r"(?i)timed? ?out|timeout|connection|temporar|reset by peer|rate.?limit|too many requests|\b(429|5\d\d)\b"), F.lit(False))


def repeats_ngram(col: Column, n: int = 3, times: int = 3) -> Column:
    """Whether some run of n tokens occurs at least ``times`` times; false for null and short texts.

    An Arrow UDF: counting takes time in proportion to the text, which nested
    array functions, evaluated anew per element, do not.
    """

    @F.pandas_udf("boolean")
    def loops(values):  # noqa: ANN001, ANN202
        from collections import Counter

        def one(t: str | None) -> bool:
            w = t.split() if isinstance(t, str) else []
            return max(Counter(zip(*(w[k:] for k in range(n)))).values(), default=0) >= times

        return values.map(one).astype(bool)

    return loops(col)


def age_years(on: Column, born: Column) -> Column:
    """Days over 365.25, two decimals, halves to even."""
    return F.bround(F.datediff(on, born) / 365.25, 2)


def blank_to_null(col: Column) -> Column:
    """Trimmed value, null for '' and for the words that stand for nothing."""
    t = F.trim(col.cast("string"))
    return F.when(~t.isin("", "nan", "None", "<NA>"), t)


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den, null where den is 0 or null."""
    return num / F.nullif(den, F.lit(0))
