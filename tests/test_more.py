import io as bytes_io
import math
import random
import wave

import pytest
from pyspark.sql import functions as F

from plenora.functions import align
from plenora.operators import decide, ledger, metrics, panel, resolve, select, sequence, stats, validate
from plenora.sources import io
from plenora.streaming import ingest


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def shards(sizes, limit):
    out, held, no = [], 0, 0
    for s in sizes:
        out.append(no)
        held += s or 0
        if held >= limit:
            held, no = 0, no + 1
    return out


@pytest.mark.parametrize("limit,chunk", [(100, 3), (100, 1000), (7, 5), (1, 4), (10_000, 6)])
def test_shards_close_when_full(spark, limit, chunk):
    rnd = random.Random(limit)
    sizes = [60] * 6 + [rnd.choice([0, 1, 5, 40, 99, 100, 250, None]) for _ in range(120)]
    df = frame(spark, [(i, s, i // chunk, "x") for i, s in enumerate(sizes)], "i long, size long, part long, chunk string")
    got = {r.i: r.shard for r in ledger.pack_by_size(df.repartition(5), ["i"], "size", limit, "part").collect()}
    assert [got[i] for i in range(len(sizes))] == shards(sizes, limit)
    assert ledger.pack_by_size(df.filter("false"), ["i"], "size", limit, "part").count() == 0


def test_selection(spark):
    df = frame(spark, [("a", 1, 5, 0.9, 4.0), ("b", 2, 5, 0.5, 4.0), ("c", 1, 6, None, 9.0), ("d", 1, 6, 0.8, 9.0)], "id string, speaker_id int, session int, quality double, duration_s double")
    ids = lambda **k: {r.id for r in select.select_rows(df, "id", **k).collect()}
    assert ids() == set("abcd") and ids(min_quality=0.7) == {"a", "d"} and ids(speakers=[1], max_s=5) == {"a"} and ids(sessions=[6], limit=1) == {"c"} and ids(limit=2, seed=1) == ids(limit=2, seed=1)
    assert ids(ids=df.filter("id = 'b'")) == {"b"}
    parts = [{r.id for r in select.hash_part(df, "id", 3, k).collect()} for k in range(3)]
    assert set().union(*parts) == set("abcd") and sum(map(len, parts)) == 4
    kept = select.without(df, df.filter("session = 5"), ["session"])
    assert {r.id for r in kept.collect()} == {"c", "d"}
    assert [r.id for r in select.seeded_sample(df.repartition(3), "id", 3, 4).orderBy("id").collect()] == [r.id for r in select.seeded_sample(df, "id", 3, 4).orderBy("id").collect()]


def test_word_rule_and_bands(lit):
    ok = lambda n, r, s, k: lit(select.words_ok(F.lit(n), F.lit(r), F.lit(s), F.lit(k)))
    assert ok(10, 10, 0.0, 0) and ok(12, 10, 0.1, 2) and not ok(13, 10, 0.0, 0) and not ok(10, 10, 0.11, 0) and not ok(10, 10, 0.0, 3) and not ok(1, 0, 0.0, 0)
    assert [lit(select.band(F.lit(x).cast("double"), [0, 0.5, 1.0])) for x in (0.0, 0.5, 1.0, None)] == ["[0, 0.5)", "[0.5, 1)", None, None]


def test_candidates_and_quotas(spark):
    df = frame(spark, [(1, s, d, m) for s, d, m in [(5, "2020", 4.0), (6, "2021", 3.0), (7, "2022", 2.0), (8, "2019", 9.0)]], "who int, session int, day string, m double")
    assert {r.session for r in select.candidate_rows(df, "who", "session", "day", F.col("m"), 5.0).collect()} == {7, 6}
    rows = frame(spark, [("g", sub, i) for sub in "abc" for i in range(9)], "g string, sub string, i int")
    assert select.quota_of_groups(rows, "g", "sub", [F.col("i")], 7).count() == 6 and select.quota_of_groups(rows, "g", "sub", [F.col("i")], 2).count() == 3
    spread = select.spread_sample(frame(spark, [("g", i % 5, str(i)) for i in range(50)], "g string, s int, k string"), "g", "s", "k", 4).collect()
    assert len(spread) == 4 and len({r.s for r in spread}) == 4
    few = select.spread_sample(frame(spark, [("g", i % 2, str(i)) for i in range(50)], "g string, s int, k string"), "g", "s", "k", 4)
    assert few.count() == 4


def test_wide_columns_need_a_unique_key(spark):
    rows, wide = frame(spark, [(1, "a"), (2, "b"), (None, "c")], "k int, v string"), frame(spark, [(1, "long"), (3, "x")], "k int, t string")
    assert sorted((r.v, r.t) for r in select.attach_wide(rows, wide, "k", ["t"]).collect()) == [("a", "long"), ("b", None), ("c", None)]
    with pytest.raises(Exception, match="not unique"):
        select.attach_wide(rows, wide.union(wide), "k", ["t"]).collect()


def test_prompts_break_at_dropped_rows(spark):
    df = frame(spark, [(1, i, t, k) for i, (t, k) in enumerate([("a", True), ("b", True), ("c", False), ("d", True), ("e", None), ("f", True)])], "g int, i int, t string, k boolean")
    got = sequence.previous_kept(df, ["g"], ["i"], F.col("k"), "t", "p").orderBy("i").collect()
    assert [(r.t, r.p) for r in got] == [("a", None), ("b", "a"), ("d", None), ("f", None)]


def test_curves(spark):
    df = frame(spark, [(s, i, float(10 - i) if i < 3 else 9.0) for s in "ab" for i in range(4 if s == "a" else 2)] + [("c", 0, 1.0)], "s string, i int, v double")
    assert {(r.i, r.n) for r in sequence.median_while_present(df, "s", "i", "v").collect()} == {(0, 3), (1, 2)}
    assert {r.s: (r.best_step, r.best) for r in sequence.curve_minimum(df, ["s"], "i", "v").collect()}["a"] == (2, 0.8)


def test_ranks_over_all_rows(spark):
    rnd = random.Random(2)
    vals = [rnd.randrange(200) for _ in range(1500)] + [None]
    got = sequence.average_rank(frame(spark, [(v,) for v in vals], "v int").repartition(6), [], "v", "r").collect()
    ok = sorted(v for v in vals if v is not None)
    first, last = {}, {}
    for i, v in enumerate(ok, 1):
        first.setdefault(v, i)
        last[v] = i
    assert all(r.r == (None if r.v is None else (first[r.v] + last[r.v]) / 2) for r in got) and len(got) == 1501


def test_two_sided(spark):
    zs = [0.0, 0.01, 0.5, 1.96, 2.999, 3.0, 3.5, 5.0, 8.0]
    got = frame(spark, [(z,) for z in zs], "z double").select(stats.two_sided(F.col("z")).alias("p")).collect()
    assert all(abs(r.p - math.erfc(z / math.sqrt(2))) < 1e-9 for z, r in zip(zs, got))


def test_poisson_replicates(spark):
    df = frame(spark, [("g", i, 1) for i in range(3000)] + [(None, 1, 1)], "g string, i int, w int")
    sums = stats.resampled_sums(df, "g", ["i"], ["w"], 60)
    got = sorted((r["__b"], r.w) for r in sums.collect())
    assert len(got) == 60 and abs(sum(w for _, w in got) / 60 - 3000) < 30 and 30 < (sum((w - 3000) ** 2 for _, w in got) / 60) ** 0.5 < 90
    assert got == sorted((r["__b"], r.w) for r in stats.resampled_sums(df.repartition(7), "g", ["i"], ["w"], 60).collect())
    two = frame(spark, [(k, k % 2 * 1.0, "ab"[k % 2], "x") for k in range(20)], "k int, y double, l string, one string")
    r = {(x.rule, x.outcome): x for x in stats.permutation_rank(two, {"l": "l", "o": "one"}, "k", ["y"], 100).collect()}
    assert r["l", "y"].eta2 == 1.0 and r["l", "y"].p < 0.05 and r["l", "y"].flag and not r["o", "y"].flag


def test_restored_words_keep_their_spelling(spark):
    got = frame(spark, [('the "budget", committee', "the budget er committee", "er!")], "a string, b string, c string").select(align.restore_shared("a", "b", "c").alias("r")).first().r
    assert (got.text, got.n_inserted) == ('the "budget", er committee', 1)
    assert frame(spark, [(["a", "b", "a"], ["a"])], "a array<string>, b array<string>").select(align.multiset_rest("a", "b").alias("x")).first().x == ["b", "a"]


def test_panel(spark):
    assert panel.grid(spark, a=[1, 2], b=["x"]).count() == 2
    plan = panel.widened_sessions(frame(spark, [(1, s, 2.0) for s in range(1, 8)] + [(2, 1, 1.0)], "who int, session int, m double"), "who", "session", F.col("m"), 3.0, 1.0, 4.0)
    assert {(r.who, r.session): (r.part, r.enough) for r in plan.collect()} == {(1, 7): ("test", True), (1, 6): ("test", True), (1, 5): ("dev", True), (1, 4): ("train", True), (1, 3): ("train", True), (2, 1): ("test", False)}
    folds = panel.fold_plan(frame(spark, [(1, 0), (2, 1)], "k int, fold int"), frame(spark, [(9, 2), (8, 77)], "k int, attach int"), "k", frame(spark, [(9,), (1,)], "k int"))
    assert {tuple(r) for r in folds.collect()} == {(1, 0, False), (9, 1, True)}
    stages = {"A": ["lr"], "B": ["rank", "drop"], "C": ["aug"]}
    options = {"lr": [1, 2], "rank": [8, 32], "drop": [0.0, 0.1], "aug": [True]}
    assert [x["lr"] for x in panel.stage_settings({}, stages, options, [])] == [1, 2]
    assert len(panel.stage_settings({"lr": 2}, stages, options, ["A"])) == 4 and panel.stage_settings({}, stages, options, ["A", "B", "C"]) == []
    t = panel.significance_tally(frame(spark, [(1, 0.1, 0.05, 0.2), (1, 0.1, -0.1, 0.2), (1, -0.1, -0.2, 0.1), (1, -0.1, -0.2, -0.05)], "k int, d double, lo double, hi double"), ["k"], "d", "lo", "hi").first()
    assert tuple(t) == (1, 1, 1, 1, 1)


def test_decisions(lit, spark):
    assert lit(decide.insertion_source(F.lit(0.5), F.lit(0.4), F.lit(0.5), F.lit(0.4))) == pytest.approx(0.9) and lit(decide.insertion_source(F.lit(0.5), F.lit(0.5), F.lit(1.0), F.lit(0.0))) is None
    base, known = frame(spark, [(1, 0.5), (2, 0.3)], "k int, r double"), frame(spark, [(1, 0.35), (2, 0.25)], "k int, r double")
    assert [r.k for r in decide.base_check(base, known, "k", "r").collect()] == [1]
    assert [lit(panel.top_budget(F.lit(x))) for x in (1440, 1439)] == [1440, 1200] and lit(panel.sample_index(F.lit(0.00003125))) == 0


def test_validation(spark):
    runs = frame(spark, [("a", "A", "m1", "שלום", "שלום", None), ("a", "B", "m2", "שלום", "x", None), ("b", "A", "m1", "ref", "", "timeout")], "id string, arm string, model string, reference string, hypothesis string, error string")
    r = validate.run_checks(runs, "id", "arm", ["A", "B"], frame(spark, [("a",), ("b",)], "id string")).first()
    assert (r.no_errors, r.unique, r.not_empty, r.same_keys, r.paired, r.different_models) == (False, True, False, True, False, True)
    index = frame(spark, [("a", 1), ("b", 1), ("c", 1)], "id string, v int")
    c = {x.check: x.offenders for x in validate.final_checks(runs.withColumn("v", F.lit(1)), index, "id", "arm", ["v"], {}, F.lit(True)).collect()}
    assert c["coverage"] == 1 and c["pending"] == 1 and c["one_row"] == 0 and c["foreign"] == 0 and c["empty"] == 1 and c["differs_v"] == 0
    assert validate.same_tables(runs, runs.repartition(2)).first().equal and validate.same_tables(runs, runs.limit(1)).first().only_a == 2
    g = validate.gate_verdict(frame(spark, [(0.1, "test", "s1"), (0.9, "dev", "s2")] * 1, "q double, p string, s string"), F.col("q") < 0.5, "p", "s").first()
    assert (g.share, g.sessions, g.passed) == (0.5, ["s1"], False)
    m = validate.reconcile_failures(frame(spark, [(1, None), (2, "HTTP 503"), (3, None)], "k int, error string"), frame(spark, [(1,)], "k int"), frame(spark, [(2, None), (3, None)], "k int, error string"), "k")
    assert {x.k: (x.error, x.retry) for x in m.collect()} == {1: (None, False), 2: (None, False), 3: ("no rows", False)}


def test_name_only_labels_of_seated_persons(spark):
    rows = frame(spark, [("levi", "2020-01-01"), ("levi", "2010-01-01"), ("dan levi", "2020-01-01"), (None, "2020-01-01")], "c string, d string").withColumn("d", F.col("d").cast("date"))
    stints = frame(spark, [(1, "2019-01-01", None), (2, "2009-01-01", "2011-01-01")], "p int, start string, end string").select("p", F.col("start").cast("date").alias("start"), F.col("end").cast("date").alias("end"))
    v = frame(spark, [(1, "levi"), (2, "levi"), (2, "dan levi")], "p int, v string")
    got = {(r.c, str(r.d)): (r.p, r.how) for r in resolve.seated_match(rows, "c", "d", v, "p", "v", stints).collect()}
    assert got == {("levi", "2020-01-01"): (1, "exact"), ("levi", "2010-01-01"): (2, "exact"), ("dan levi", "2020-01-01"): (None, None), (None, "2020-01-01"): (None, None)}
    s = resolve.verified_sessions(frame(spark, [(1, True)] * 9 + [(1, None), (2, False)], "s int, ok boolean"), "s", F.col("ok"))
    assert {r.s: r.accepted for r in s.collect()} == {1: True, 2: False}


def test_files_and_ledgers(spark, tmp_path):
    df = frame(spark, [(1, "a"), (2, "b")], "k int, v string")
    assert io.unique_on(df, ["k"]) is df
    with pytest.raises(ValueError, match="not unique"):
        io.unique_on(df.union(df), ["k"])
    assert io.write_and_record(df, str(tmp_path / "d"), str(tmp_path / "l"), "k") == 2 and io.write_and_record(df, str(tmp_path / "d"), str(tmp_path / "l"), "k") == 0
    pins = io.pin_files(spark, str(tmp_path / "d")).cache()
    assert pins.count() > 0 and io.changed_files(io.pin_files(spark, str(tmp_path / "d")), pins).count() == 0
    io.append_rows(df, str(tmp_path / "log"))
    io.append_rows(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    io.write_csv(frame(spark, [(0.123456789, "x")], "f double, s string"), str(tmp_path / "csv"))
    (tmp_path / "bom.csv").write_bytes("﻿f,s\n0.5,x\n".encode())
    back = io.read_dimension(spark, str(tmp_path / "bom.csv"), io.T.StructType.fromDDL("f double, s string")).first()
    assert (back.f, back.s) == (0.5, "x") and spark.read.option("header", True).csv(str(tmp_path / "csv")).first().f == "0.123457"
    assert io.drop_matching(df, "^v").columns == ["k"] and '"k":1' in io.summary_json(df.filter("k = 1")).first().json
    assert {r.name for r in io.list_files(spark, str(tmp_path), "bom.csv").collect()} == {"bom.csv"} and ledger.to_do(df, df.filter("k = 1"), ["k"]).count() == 1
    calls = str(tmp_path / "calls")

    def fetch(off, n):
        open(calls, "a").write("x")
        return [{"id": i // 2} for i in range(off, min(off + n, 20))]

    for _ in range(2):
        assert io.cached_pages(fetch, spark, io.T.StructType.fromDDL("id bigint"), 20, "id", str(tmp_path / "cache"), "q", 5).count() == 10
    assert len(open(calls).read()) == 4


def test_audio_and_answers(spark):
    raw = bytes_io.BytesIO()
    with wave.open(raw, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(100)
        w.writeframes(b"".join((i * 100).to_bytes(2, "little", signed=True) for i in range(100)))
    got = frame(spark, [(raw.getvalue(), 0.1, 0.2), (b"junk", 0.0, 1.0), (None, 0.0, 1.0)], "c binary, a double, b double").select(io.wav_span("c", "a", "b").alias("x")).collect()
    assert got[0].x.rate == 100 and len(got[0].x.samples) == 10 and got[0].x.samples[0] == pytest.approx(1000 / 32768) and got[1].x.rate is None and got[2].x.rate is None
    answer = '[{"events": [{"type": "segments", "segments": [{"text": " a b"}, {"text": "c "}]}, {"type": "other", "segments": [{"text": "no"}]}]}, {}]'
    assert [r.t for r in frame(spark, [(answer,), ("[]",)], "j string").select(io.provider_text(F.col("j")).alias("t")).collect()] == ["a b c", ""]


def test_ledgers_maps_and_queues(spark, lit):
    a, b = frame(spark, [(1, "a"), (1, "b"), (2, None)], "k int, v string"), frame(spark, [(2, "z"), (3, "c")], "k int, v string")
    assert {r.k: r.v for r in ledger.union_unique(a, b, ["k"]).collect()} == {1: "b", 2: None, 3: "c"}
    assert ledger.ledger_union(a.select("k"), b.select("k"), a.select("k")).count() == 3
    assert lit(io.speaker_map(F.lit("1\tdan\nbad line\n 2 \truth b\tx\n1\tdana"))) == {1: "dana", 2: "ruth b\tx"}
    assert [lit(metrics.map_values(F.lit(x).cast("string"), {"a": "A"}, "?")) for x in ("a", "b", None)] == ["A", "?", "?"]
    q = {r.status: r for r in ledger.queue_rollup(frame(spark, [("done", 2.0, 4.0), ("pending", 3.0, None)], "status string, est double, actual double"), "status", "est", "actual", 0.5).collect()}
    assert (q["pending"].minutes_left, q["pending"].cost_left, q["done"].minutes_left) == (6.0, 3.0, 0.0)
    words = frame(spark, [(1, 0, 0.2), (1, 0, 0.4), (1, 0, 0.9), (1, 1, 0.5)], "session_id int, seg int, p double")
    assert {r.seg: (r.quality, r.n_words) for r in io.segment_quality(words).collect()} == {0: (0.4, 3), 1: (0.5, 1)}
    files = frame(spark, [("x/a.json", 3, "x", "a.json"), ("x/b.json", 4, "x", "b.json")], "path string, length long, folder string, name string")
    assert tuple(io.files_by_folder(files).first()) == ("x", ["a.json", "b.json"], 2, 7)


def test_stream_without_repeats(spark, tmp_path):
    src = frame(spark, [(1, 10), (1, 20), (2, 15)], "k int, s int").select("k", F.timestamp_seconds("s").alias("ts"))
    src.write.parquet(str(tmp_path / "in"))
    q = ingest.unique_events(ingest.file_stream(spark, str(tmp_path / "in"), src.schema), ["k"], "ts", "1 hour").writeStream.format("memory").queryName("uniq").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.k for r in spark.table("uniq").collect()) == [1, 2]
    wins = ingest.sliding_counts(src, "ts", "20 seconds", "10 seconds", "1 minute").collect()
    assert sum(r.n for r in wins) == 6
