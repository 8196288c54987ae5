"""One consistent form for texts that look the same in different characters.

The form is compatibility-normalised and composed, with default-ignorable
characters removed, every kind of blank mapped to a space, the kinds of quote,
apostrophe and hyphen made one each, and look-alike letters of other scripts
mapped to one prototype. Compatibility forms that a reader can tell apart
(superscripts, subscripts, fractions, circled and squared characters) stay.
Full case folding is an option, for comparisons that ignore case. Work is done
once per distinct value of an Arrow batch.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenora.operators.skew import filter_bits, hot_keys, in_filter, key_filter, salted_join
from plenora.session import written

# Characters whose look equals that of the ASCII character or letter at the same place.
_LOOKS = {
    "\"": "“”„‟″‶״❝❞〝〞〟＂«»ʺˮ〃",
    "'": "‘’‚‛′‵׳ʼʻʹʽˈˊˋ`´❛❜＇｀᾿᾽՚ꞌߴߵ",
    "-": "−˗⁃➖֊־",
    ".": "․",
    "וו": "װ",
    "וי": "ױ",
    "יי": "ײ",
}
# Cyrillic and Greek letters and the Latin letters they look like, in the same order.
_CYRILLIC = ("аеорсухѕіјһԁԛԝӏАВЕКМНОРСТУХЅІЈӀԌԚԜҮ", "aeopcyxsijhdqwlABEKMHOPCTYXSIJIGQWY")
_GREEK = ("ονϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "ovcjABEZHIKMNOPTYXCJ")
# Letters of Armenian, Cherokee and Coptic and further Latin ones, with the Latin letters they look like, in the same order.
_ARMENIAN = ("օոսհցզՕՍ", "onuhgqOU")
_CHEROKEE = ("ᎪᎫᎠᎡᎢᎥᎩᎳᎷᎻᏀᏃᏎᏏᏔᏕᏙᏚᏞᏟᏢᏦᏴ", "AJDRTiYWMHGZ4bWSVSLCPKB")
_COPTIC = ("ⲟⲞⲤⲢⲔⲘⲎ", "oOCPKMH")
_LATIN = ("ɑɡᴄᴏᴠᴡᴢꜱ", "agcovwzs")

#: Tags of compatibility mappings that change the look.
_SEEN = ("<super>", "<sub>", "<fraction>", "<circle>", "<square>", "<vertical>")
#: Format characters that are drawn.
_DRAWN = re.compile("[؀-؅۝܏࢐࢑࣢\U000110bd\U000110cd]")
_IGNORABLE = re.compile("[͏ᅟᅠ឴឵᠋-᠏⁥ㅤﾠ︀-️\U000e0000-\U000e0fff]")


def _char_map(strip_marks: bool) -> dict[int, str]:
    """A ``str.translate`` table that works out each character at its first use."""
    looks = {ord(c): to for to, group in _LOOKS.items() for c in group}
    looks |= {ord(a): b for pair in (_CYRILLIC, _GREEK, _ARMENIAN, _CHEROKEE, _COPTIC, _LATIN) for a, b in zip(*pair, strict=True)}

    def one(ch: str) -> str:
        kind = unicodedata.category(ch)
        if ord(ch) in looks:
            return looks[ord(ch)]
        if _IGNORABLE.match(ch) or (kind == "Cf" and not _DRAWN.match(ch)):
            return ""
        if kind[0] == "Z" or ch in "\t\n\v\f\r\x1c\x1d\x1e\x1f\x85":
            return " "
        if kind == "Cc":
            return ""
        if kind == "Pd":
            return "-"
        if strip_marks and kind[0] == "M":
            return ""
        return ch

    class Table(dict):
        def __missing__(self, code: int) -> str:
            ch = chr(code)
            tag = unicodedata.decomposition(ch).partition(" ")[0]
            # What has a look of its own is mapped before it would be taken apart.
            parts = ch if code in looks or tag in _SEEN else unicodedata.normalize("NFKD", ch)
            if code not in looks and unicodedata.category(ch)[0] == "Z":
                parts = " "
            self[code] = made = "".join(map(one, parts))
            return made

    return Table()


#: Anything but characters that stay as they are: ASCII without the grave accent, Hebrew letters, Arabic letters that do not decompose.
_SPECIAL = re.compile("[^\n !-_a-~א-תءا-غف-ي]")


class Canoniser:
    """Callable text -> canonical form. One per task; its table fills as characters turn up.

    ``lines`` keeps line breaks; blanks at either end go unless ``trim`` is false.
    """

    def __init__(self, fold_case: bool = False, strip_marks: bool = False, trim: bool = True, lines: bool = False):
        self.fold_case, self.trim, self.lines = fold_case, trim, lines
        self.table = _char_map(strip_marks)
        if lines:
            self.table[10] = "\n"

    def __call__(self, text: str) -> str:
        if _SPECIAL.search(text):
            s = text.translate(self.table)
            if not s.isascii():
                s = unicodedata.normalize("NFC", s)
        else:
            s = text if self.lines else text.replace("\n", " ")
        if self.fold_case:
            folded = s.casefold()
            s = folded if folded.isascii() or folded == s else unicodedata.normalize("NFC", folded)
        return s.strip() if self.trim else s


def canonical(col: Column, fold_case: bool = False, strip_marks: bool = False) -> Column:
    """Canonical form of a string column; null stays null, empty stays empty, length is not limited.

    Blanks at either end are removed; blanks inside are each mapped to a space.
    """

    @F.pandas_udf("string")
    def form(values):  # noqa: ANN001, ANN202
        make = Canoniser(fold_case, strip_marks)
        known = {v: make(v) for v in values.dropna().unique()}
        return values.map(known, na_action="ignore").astype(object).where(values.notna(), None)

    return form(col)


def _digest(s: str) -> bytes:
    return hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def form_digests(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text digest, form digest) of every row whose text and form are not empty.

    The texts themselves are not shuffled; digests have 128 bits. Rows with a
    null id or text, an empty text or one that shows nothing are left out.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Canoniser()
        for b in batches:
            enc = b.column(1).dictionary_encode()
            made = []
            for t in enc.dictionary.to_pylist():
                form = make(t) if t else ""
                made.append((_digest(t), _digest(form)) if form else (None, None))
            raw = pa.array([m[0] for m in made], pa.binary()).take(enc.indices)
            forms = pa.array([m[1] for m in made], pa.binary()).take(enc.indices)
            yield pa.RecordBatch.from_arrays([b.column(0), raw, forms], names=["id", "raw", "form"])

    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("t")).filter("id IS NOT NULL AND t IS NOT NULL AND t <> ''")
    return rows.mapInArrow(work, "id string, raw binary, form binary").filter("form IS NOT NULL")


def look_alike_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Ids of rows for which a row of another id has a different text of the same look.

    Texts are formed once. Rows are reduced to (form, text) on the map side, so
    a text that a third of all rows share costs one row a task; of each form it
    is then known whether it has several texts and several ids, which makes all
    its ids cases: an id with one of the texts differs from whoever has another,
    and an id with several of them differs from any other id. Only rows that
    pass a bit set of these forms are shuffled, hot forms salted. Output: id, distinct.
    """
    rows = written(form_digests(df, id_col, text_col))
    texts = rows.groupBy("form", "raw").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    forms = texts.groupBy("form").agg(F.count(F.lit(1)).alias("n_texts"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    several = written(forms.filter("n_texts > 1 AND lo <> hi").select("form"))
    bits = key_filter(several, F.xxhash64("form"), filter_bits(several.count()))
    hashed = rows.select("id", "form", F.xxhash64("form").alias("__h"))

    def passing(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.select(["id", "form"]).filter(pa.array(in_filter(bits, b.column(2).to_numpy(zero_copy_only=False).view("uint64"))))

    some = written(hashed.mapInArrow(passing, "id string, form binary").distinct())
    return salted_join(some, several, "form", hot_keys(some, "form", some.count()), ["id"], "left_semi").select("id").distinct()


def look_alike_pairs(df: DataFrame, left: str, right: str) -> DataFrame:
    """Rows whose two text columns are different strings of the same look; a null on either side is no case."""
    two = df.filter(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
    return two.filter(canonical(F.col(left)) == canonical(F.col(right)))
