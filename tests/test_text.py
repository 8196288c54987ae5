import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from plenora.functions import text as tx
from plenora.functions.align import distance, edit_counts, edit_ops, exact_distance, restore_shared, runaway, word_distance
from plenora.functions.binning import cut, weighted_median
from plenora.plans.scoring import scored_chunks
from tests.conftest import DATA


@pytest.mark.parametrize("raw,want", [('צה"ל', "צה ל"), ("אונ׳", "אונ"), ("בין-לאומי", "בין לאומי"), ("שָׁלוֹם", "שלום"), ("Hello, world! 123", "Hello world 123"), (None, ""), ("", ""), ("a_b", "a b")])
def test_normalize(lit, raw, want):
    assert lit(tx.normalize_text(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize("raw,bad", [("דוד: שלום", True), ("דוד 7", True), ("א" * 61, True), ("a b c d e f g h i", True), ("אורן בדוי (" + "ת" * 80 + ")", False), (None, True), ("  ", True), ("(x)", True), ("דוד לוי", False)])
def test_garbage(lit, raw, bad):
    assert lit(tx.is_garbage_name(F.lit(raw).cast("string"))) is bad


def test_clean_and_chair(lit):
    assert lit(tx.clean_name(F.lit('היו"ר דוד לוי (סיעה)'))) == "דוד לוי"
    assert lit(tx.clean_name(F.lit("השרה רות כהן"))) == "רות כהן"
    assert lit(tx.clean_name(F.lit("12"))) is None
    assert lit(tx.is_chairman(F.lit('היו"ר דוד לוי'))) is True
    assert lit(tx.is_chairman(F.lit(None).cast("string"))) is False


def test_spellings(lit):
    got = lit(tx.spelling_variants(F.lit("אברהם"), F.lit("לוי"), F.lit("אברהם (אבי) לוי")))
    assert got == sorted({"אברהם לוי", "לוי אברהם", "אבי לוי", "לוי אבי"})
    assert lit(tx.spelling_variants(F.lit("רות"), F.lit("כהן"), F.lit(None).cast("string"))) == ["כהן רות", "רות כהן"]


def test_ids(lit):
    assert lit(tx.span_id(F.lit(4405), F.lit(2073683), F.lit(14.6), F.lit(16.94))) == "4405_2073683_14600_16940.flac"
    back = lit(tx.parse_span_id(F.lit("x/4405_2073683_14600_16940.flac")))
    assert (back.speaker_id, back.session, back.start_s, back.end_s) == (4405, 2073683, 14.6, 16.94)
    assert lit(tx.parse_span_id(F.lit("nonsense"))).session is None
    assert lit(tx.protocol_session(F.lit("25_ptv_600.DOCX"))) == 25
    assert lit(tx.swap_extension(F.lit("a.flac.flac"), "flac", "wav")) == "a.flac.wav"
    assert lit(tx.sortable_key(F.lit("2020-01-02"), F.lit(7))) == "2020-01-02_7"
    assert lit(tx.name_field(F.lit("s1_lr0.0003_r8"), "lr")) == "0.0003"


def test_time_token(lit):
    assert lit(tx.time_token(F.lit(0.0))) == "<|0.00|>"
    assert lit(tx.time_token(F.lit(4.163))) == "<|4.16|>"
    with pytest.raises(Exception, match="out of range"):
        lit(tx.time_token(F.lit(30.5)))


def test_counts_and_flags(lit):
    assert [lit(tx.token_count(F.lit(x).cast("string"))) for x in ("", None, "a b")] == [0, 0, 2]
    assert lit(tx.collapse_blanks(F.lit(" a  \n b "))) == "a b"
    assert lit(tx.compression_ratio(F.lit("")).alias("x")) == 0
    assert lit(tx.compression_ratio(F.lit("la la la " * 60))) > 3.0 > lit(tx.compression_ratio(F.lit("the committee met on tuesday to hear the report of the auditor")))
    assert lit(tx.repeats_ngram(F.lit("a b c " * 3))) is True
    assert lit(tx.repeats_ngram(F.lit("a b c d e f g h i"))) is False
    assert lit(tx.repeats_ngram(F.lit(None).cast("string"))) is False
    assert lit(tx.is_transient_error(F.lit("HTTP 503"))) is True
    assert lit(tx.is_transient_error(F.lit("bad payload"))) is False
    assert lit(tx.age_years(F.lit(date(2020, 1, 1)), F.lit(date(1950, 1, 1)))) == 70.0
    assert [lit(tx.blank_to_null(F.lit(x))) for x in (" ", "None", " a ")] == [None, None, "a"]
    assert lit(tx.nfkc(F.lit("Ａ"))) == "A"


def test_halves_go_to_even(lit):
    assert [lit(tx.to_ms(F.lit(x))) for x in (0.0005, 0.0015)] == [0, 2]


def test_distances(lit):
    cases = [("a b c d", "a b c d", 0, (0, 0, 0)), ("a b c d", "a x c d", 1, (1, 0, 0)), ("a b c d", "a c d", 1, (0, 1, 0)), ("a b c d", "a b q c d", 1, (0, 0, 1)), ("a b c", "a x c y", 2, (1, 0, 1)), ("", "", 0, (0, 0, 0)), ("", "a", 1, (0, 0, 1)), ("a", "", 1, (0, 1, 0))]
    for r, h, d, sdi in cases:
        assert lit(word_distance(F.lit(r), F.lit(h))) == d
        c = lit(edit_counts(F.lit(r), F.lit(h)))
        assert (c.S, c.D, c.I) == sdi and c.werr == d
    assert lit(word_distance(F.lit(None).cast("string"), F.lit("a b"))) == 2
    assert lit(runaway(F.lit(4), F.lit(13))) is True and lit(runaway(F.lit(4), F.lit(12))) is False


def test_distance_beyond_the_native_limit(spark, lit, tmp_path):
    rnd = random.Random(3)
    for _ in range(300):
        r, h = ([rnd.choice("abcd") for _ in range(rnd.randrange(0, 80))] for _ in range(2))
        assert distance(r, h) == sum(o != "=" for o, _, _ in edit_ops(r, h))
    long = [f"w{k}" for k in range(4000)]
    short = [w for k, w in enumerate(long) if k % 9 != 4]
    texts = F.lit(" ".join(long)), F.lit(" ".join(short))
    assert lit(word_distance(*texts)) is None
    assert lit(exact_distance(*texts)) == len(long) - len(short)
    chunk = spark.read.parquet(f"{DATA}/sf0.001/chunk_index.parquet").filter("chunk_id IS NOT NULL").limit(1)
    two = chunk.withColumns({"chunk_id": F.lit("long"), "text": texts[0]}).unionByName(chunk.withColumns({"chunk_id": F.lit("brief"), "text": F.lit("a b c d e f")}))
    two.write.parquet(str(tmp_path / "chunk_index.parquet"))
    got = {r.chunk_id: (r.words, r.err_a, r.err_b) for r in scored_chunks(spark, str(tmp_path)).collect()}
    changed = [w if k % 7 != 2 else "x" for k, w in enumerate(long)]
    assert got["long"] == (4000, distance(long, [w for k, w in enumerate(changed) if k % 5 != 3]), len(long) - len(short))
    assert got["brief"] == (6, 2, 1)


def test_edit_ops_invariants():
    import random

    rnd = random.Random(1)
    for _ in range(200):
        r, h = ([rnd.choice("abcd") for _ in range(rnd.randrange(9))] for _ in range(2))
        ops = [o for o, _, _ in edit_ops(r, h)]
        assert ops.count("D") - ops.count("I") == len(r) - len(h)
        table = list(range(len(h) + 1))
        for i, x in enumerate(r, 1):
            diag, table[0] = table[0], i
            for j, y in enumerate(h, 1):
                diag, table[j] = table[j], min(diag + (x != y), table[j] + 1, table[j - 1] + 1)
        assert len(ops) - ops.count("=") == table[-1]


def test_restore_shared(lit):
    got = lit(restore_shared(F.lit("a b c"), F.lit("a um b c"), F.lit("um a b c")))
    assert (got.text, got.n_inserted) == ("a um b c", 1)
    assert lit(restore_shared(F.lit("a b c"), F.lit("a um b c"), F.lit("a b c"))).text == "a b c"
    assert lit(restore_shared(F.lit("a b"), F.lit("a um um b"), F.lit("um a b"))).n_inserted == 1
    assert lit(restore_shared(F.lit("a b c d"), F.lit("a d"), F.lit("a d"))).text == "a b c d"


def test_cut(lit):
    f = lambda x: lit(cut(F.lit(x).cast("double"), [0, 3, 6]))
    assert [f(x) for x in (0, 3, 3.1, 6, 6.1, -1, None)] == ["(0, 3]", "(0, 3]", "(3, 6]", "(3, 6]", None, None, None]


def test_weighted_median(spark):
    import numpy as np

    rnd = np.random.default_rng(3)
    data = [(g, float(rnd.integers(0, 6)) / 5, float(rnd.integers(0, 4))) for g in range(30) for _ in range(rnd.integers(1, 9))]
    data += [(99, 2.0, 0.0), (99, 4.0, 0.0), (98, 1.5, 3.0)]
    got = dict(weighted_median(spark.createDataFrame(data, "g int, v double, w double"), ["g"], "v", "w", "m").collect())
    for g in {d[0] for d in data}:
        rows = sorted((v, w) for k, v, w in data if k == g)
        v, w = np.array(rows).T
        want = np.median(v) if w.sum() <= 0 else np.interp(w.sum() / 2, np.cumsum(w) - w / 2, v)
        assert got[g] == pytest.approx(want), g
    assert weighted_median(spark.createDataFrame([], "g int, v double, w double"), ["g"], "v", "w", "m").count() == 0
