import inspect
import random

import pytest
from pyspark.sql import functions as F

from plenora.operators import checks, decide, ledger, metrics, resolve, sequence, splits, stats
from plenora.operators.chunked import next_value, running_sum
from plenora.operators.intervals import merge_close, periods_and_gaps, point_in_span
from plenora.plans import scoring
from plenora.sources import io
from tests.conftest import DATA


@pytest.mark.parametrize("name,operator,count,full", [("bootstrap_intervals", "ratio_intervals", "n_boot", 1000), ("paired_test", "paired_bootstrap", "n_boot", 2000), ("rule_ranking", "permutation_rank", "n_perm", 2000)])
def test_full_replicates(spark, monkeypatch, name, operator, count, full):
    plain, drawn = getattr(stats, operator), []

    def seen(*args, **more):
        bound = inspect.signature(plain).bind(*args, **more)
        bound.apply_defaults()
        drawn.append(bound.arguments[count])
        return plain(*args, **more)

    monkeypatch.setattr(stats, operator, seen)
    assert {"rule", "knesset"} & set(scoring.QUERIES[name](spark, f"{DATA}/sf0.001").columns)
    assert drawn == [full]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def brute_periods(spans):
    out, cur = [], None
    for s, e in sorted(x for x in spans if x[1] > x[0]):
        if cur and s <= cur[1]:
            cur[1] = max(cur[1], e)
        else:
            if cur:
                out += [("period", *cur), ("gap", cur[1], s)]
            cur = [s, e]
    return out + [("period", *cur)] if cur else out


def test_periods_and_gaps(spark):
    rnd = random.Random(5)
    rows = [(k, s, s + rnd.choice([0, 1, 5, 400_000])) for k in (1, 2, None) for s in (rnd.randrange(0, 5_000_000) for _ in range(80))] + [(3, 5, 5), (3, None, 9), (4, 10, 20), (4, 20, 30)]
    got = periods_and_gaps(frame(spark, rows, "g int, a long, b long"), ["g"], F.col("a"), F.col("b")).collect()
    for g in (1, 2, None, 3, 4):
        want = brute_periods([(s, e) for k, s, e in rows if k == g and s is not None])
        assert sorted((r.kind, r.start_ms, r.end_ms) for r in got if r.g == g) == sorted(want)
    assert periods_and_gaps(frame(spark, [], "g int, a long, b long"), ["g"], F.col("a"), F.col("b")).columns == ["g", "kind", "start_ms", "end_ms"]


def test_chunked_windows(spark):
    rows = [(g, i, i // 7, (i * 37) % 11) for g in (1, None) for i in range(50)]
    df = frame(spark, rows, "g int, i int, c int, v int")
    got = running_sum(df, ["g"], "c", [F.col("i")], F.col("v"), "s")
    got = {(r.g, r.i): (r.s, r.n) for r in next_value(got, ["g"], "c", [F.col("i")], F.col("v"), "n").collect()}
    for g in (1, None):
        total = 0
        for i in range(50):
            total += (i * 37) % 11
            assert got[g, i] == (total, ((i + 1) * 37) % 11 if i < 49 else None)


def test_point_in_span(spark):
    p, s = frame(spark, [("a", 0.5), ("a", 2.0), ("a", 2.05), ("b", 1.0), ("a", None)], "k string, t double"), frame(spark, [("a", 0.5, 2.0), ("b", 5.0, 6.0), ("a", 1.0, None)], "k string, s double, e double")
    assert sorted(r.t for r in point_in_span(p, s, ["k"], "t", "s", "e", 0.3).collect()) == [0.5, 2.0]
    assert sorted(r.t for r in point_in_span(p, s, ["k"], "t", "s", "e", 0.3, pad=0.05).collect()) == [0.5, 2.0, 2.05]
    assert sorted(r.t for r in point_in_span(p, s, ["k"], "t", "s", "e", 0.3, closed=False).collect()) == [0.5]


def test_merge_close(spark):
    df = frame(spark, [(1, 0.0, 1.0), (1, 1.1, 2.0), (2, 0.0, 1.0), (2, 2.0, 3.0), (3, 0.0, 9.0), (3, 1.0, 2.0), (3, 8.0, 9.5)], "g int, s double, e double")
    got = sorted((r.g, r.s, r.e) for r in merge_close(df, ["g"], "s", "e", 0.3).collect())
    assert got == [(1, 0.0, 2.0), (2, 0.0, 1.0), (2, 2.0, 3.0), (3, 0.0, 9.5)]


def test_greedy_windows(spark):
    six, ten = [(1, 5.0 * i, 5.0 * i + 4) for i in range(6)], [(2, 5.0 * i, 5.0 * i + 4) for i in range(10)]
    odd = [(3, 0.0, 40.0), (3, 41.0, 45.0), (4, 0.0, 5.0), (4, 3.0, 29.0), (4, 4.0, 6.0), (5, None, 3.0)]
    got = sequence.greedy_windows(frame(spark, six + ten + odd, "g int, s double, e double"), ["g"], "s", "e").orderBy("g", "window").collect()
    by = {g: [(r.seek, r.end, r.n_spans) for r in got if r.g == g] for g in range(1, 6)}
    assert by[1] == [(0.0, 29.0, 6)]
    assert by[2] == [(0.0, 29.0, 6), (29.0, 49.0, 4)]
    assert by[3] == [(41.0, 45.0, 1)]
    assert sum(x[2] for x in by[4]) == 3 and all(e - s <= 30 for s, e, _ in by[4])
    assert by[5] == []


def test_runs_and_ranks(spark):
    flags = [(1, i, f) for i, f in enumerate("TTFTTTF")] + [(2, 0, "F")]
    df = frame(spark, flags, "g int, i int, f string").withColumn("ok", F.col("f") == "T")
    assert dict(sequence.longest_run(df, ["g"], ["i"], "ok", "n").collect()) == {1: 3, 2: 0}
    r = sequence.average_rank(frame(spark, [(1, 5.0), (2, 5.0), (3, 1.0), (4, None)], "k int, v double"), [], "v", "r")
    assert {x.k: x.r for x in r.collect()} == {1: 2.5, 2: 2.5, 3: 1.0, 4: None}
    isl = sequence.islands(frame(spark, [(1, 0, None), (1, 1, None), (1, 2, 3)], "g int, i int, v int"), ["g"], ["i"], ["v"], "run")
    assert [x.run for x in isl.orderBy("i").collect()] == [1, 1, 2]


def test_early_stop(spark):
    flat = [(1, s, 1.0) for s in range(20, 400, 20)]
    df = frame(spark, flat, "g int, step int, loss double")
    assert sequence.early_stop(df, ["g"], "step", "loss", 4).first().stop_step == 100
    assert sequence.early_stop(df, ["g"], "step", "loss", 1, 200).first().stop_step == 200
    better = frame(spark, [(1, s, 0.5 if s >= 80 else 1.0) for s in range(20, 400, 20)], "g int, step int, loss double")
    assert sequence.early_stop(better, ["g"], "step", "loss", 4).first().stop_step == 160


def test_split_long_runs(spark):
    words = [(1, i, float(i), i + 0.9) for i in range(70)]
    got = sequence.split_long_runs(frame(spark, words, "g int, i int, s double, e double"), ["g"], "i", "s", "e").orderBy("piece").collect()
    assert [(r.start, round(r.end, 1)) for r in got] == [(0.0, 29.9), (30.0, 59.9), (60.0, 69.9)]


def test_session_split(spark):
    rows = [(1, s, 600.0) for s in (10, 10, 9, 8, 7, 6)]
    one = splits.session_split(frame(spark, rows, "speaker int, session int, d double"), "speaker", "session", "d", 20, 10)
    parts = {r.session: r.part for r in one.collect()}
    assert parts == {10: "test", 9: "dev", 8: "train", 7: "train", 6: "train"}
    many = splits.session_split(frame(spark, rows + [(k, s, d) for k in (2, 3, 4) for _, s, d in rows], "speaker int, session int, d double"), "speaker", "session", "d", 20, 10)
    assert {r.session: r.part for r in many.filter("speaker = 1").collect()} == parts
    assert splits.session_split(frame(spark, [], "speaker int, session int, d double"), "speaker", "session", "d", 20, 10).columns == ["speaker", "session", "d", "part"]


def test_fill_to_targets(spark):
    df = frame(spark, [(1, s, 60.0) for s in range(1, 9)], "speaker int, session int, d double")
    got = {r.session: r.part for r in splits.fill_to_targets(df, "speaker", [F.desc("session")], "session", "d", [("test", 1.5), ("dev", 1.0), ("train", 2.5)]).collect()}
    assert got == {8: "test", 7: "test", 6: "dev", 5: "train", 4: "train", 3: "train", 2: None, 1: None}


def test_budgets_and_pools(spark):
    df = frame(spark, [(k, s, 10.0) for k in (1, 2) for s in range(4)], "speaker int, s int, m double")
    pool = splits.round_robin_pool(df, "speaker", [F.asc("s")], "m", 55.0).collect()
    assert sorted((r["round"], r.speaker) for r in pool) == [(0, 1), (0, 2), (1, 1), (1, 2), (2, 1)]
    assert sequence.within_budget(df, ["speaker"], ["s"], "m", F.lit(25.0)).count() == 4
    assert sequence.until_target(df, ["speaker"], ["s"], "m", F.lit(25.0)).count() == 6
    folds = splits.hash_folds(frame(spark, [(i,) for i in range(23)], "k int"), "k", 5).collect()
    assert sorted([r.fold for r in folds].count(f) for f in range(5)) == [4, 4, 5, 5, 5]


def test_extends_plan(spark):
    old = frame(spark, [(1, "a", "train", 0), (1, "b", "train", 1), (1, "t", "test", None), (2, "x", "train", 0)], "speaker int, chunk string, part string, train_order int")
    new = frame(spark, [(1, "a", "train", 0), (1, "b", "train", 1), (1, "c", "train", 2), (1, "t", "test", None), (2, "y", "train", 0), (2, "x", "train", 1)], "speaker int, chunk string, part string, train_order int")
    got = {r.speaker: (r.same_held, r.prefix) for r in splits.extends_plan(old, new, "speaker", "chunk").collect()}
    assert got == {1: (True, True), 2: (True, False)}


def test_pooled_rates_and_groups(spark):
    df = frame(spark, [("g", 100, 50, 10.0), ("g", 400, 40, 2.0), ("h", 5, 1, 3.0), (None, 9, 9, 9.0), ("z", 0, 0, 0.0)], "k string, w int, e int, h double")
    got = {r.k: (r.words, r.err_X, r.rate_X) for r in metrics.pooled_rates(df, ["k"], "w", {"X": "e"}).collect()}
    assert got == {"g": (500, 90, 0.18), "h": (5, 1, 0.2), "z": (0, 0, None)}
    t = {r.grp: r.hours_minus_largest for r in metrics.subgroups(df, {"rule": "k"}, "h", "w", {"X": "e"}).collect()}
    assert t == {"g": 2.0, "h": 0.0, "z": 0.0}
    assert metrics.threshold_effect(df, F.col("w") >= 100, "w", {"X": "e"}).count() == 3


def test_eta_squared(spark):
    df = frame(spark, [("p", g, y) for g, y in (("a", 1.0), ("a", 1.0), ("b", 3.0), ("b", 3.0))] + [("q", g, y) for g, y in (("a", 1.0), ("a", 3.0), ("b", 1.0), ("b", 3.0))], "k string, g string, y double")
    assert {r.k: round(r.eta2, 9) for r in metrics.eta_squared(df, ["k"], "g", "y").collect()} == {"p": 1.0, "q": 0.0}


def test_majority_key(spark):
    df = frame(spark, [("a", 1)] * 3 + [("b", 1)] * 3 + [("b", 2)] + [("c", 5)] * 2 + [(None, 1)], "k string, v int")
    assert {r.k: (r.v, r.n, r.usable) for r in metrics.majority_key(df, "k", "v").collect()} == {"a": (1, 3, True), "b": (1, 3, False), "c": (5, 2, False)}


def test_tokens_agree(spark, lit):
    f = lambda a, b: lit(resolve.tokens_agree(F.lit(a).cast("string"), F.lit(b).cast("string")))
    assert f("a b", "b a") and f("a b", "a b c") and f("a b c", "a b") and f("a", "a")
    assert not f("a", "a b") and not f("a b", "a c") and not f("", "") and not f(None, "a b")


def test_unique_match(spark):
    v = frame(spark, [(1, "a b"), (2, "c d"), (3, "c d"), (1, "b a")], "p int, v string")
    n = frame(spark, [(1, "a b"), (2, "x y a b"), (3, "c d"), (4, "q"), (5, None)], "k int, clean string")
    got = {r.k: (r.p, r.how) for r in resolve.unique_match(n, "k", "clean", v, "p", "v").collect()}
    assert got == {1: (1, "exact"), 2: (1, "suffix"), 3: (None, "ambiguous"), 4: (None, None), 5: (None, None)}


def test_ladder_order(lit):
    x = lambda **k: lit(resolve.label_with_gold(*[F.lit(k.get(n, d)) for n, d in (("off", True), ("gold", "7"), ("valid", True), ("garb", False), ("known", True), ("agree", True), ("seated", True), ("gate", "none"))]))
    assert tuple(x()) == ("mk", None)
    assert tuple(x(off=False, gold="x")) == ("unresolved", "bad_offset")
    assert tuple(x(gold="guest")) == ("non_mk", "gold_guest")
    assert tuple(x(garb=True, known=False)) == ("unresolved", "raw_garbage")
    assert tuple(x(seated=False, gate="deceased")) == ("unresolved", "deceased")
    assert tuple(x(seated=False)) == ("former_mk", None)


def test_place_texts(spark):
    df = frame(spark, [(1, "one two one three", ["one", "one", "two", "zzz"])], "k int, t string, ps array<string>")
    assert [(r.ix, r.at) for r in resolve.place_texts(df, "k", "t", "ps").orderBy("ix").collect()] == [(0, 0), (1, 8), (2, 4), (3, None)]


def test_contamination(spark):
    rows = [(i, "a", [1.0, 0.01 * i]) for i in range(8)] + [(10 + i, "b", [0.01 * i, 1.0]) for i in range(8)] + [(99, "a", [0.0, 1.0]), (98, "a", None)]
    got = {r.k: r.margin for r in resolve.contamination(frame(spark, rows, "k int, l string, v array<double>"), "k", "l", "v").collect()}
    assert got[99] < 0 and all(m > 0 for k, m in got.items() if k != 99) and 98 not in got


def test_bootstrap(spark):
    rows = [("x", i, 10, 1, 0) for i in range(60)] + [("same", i, 10, 1, 1) for i in range(60)]
    df = frame(spark, rows, "g string, i int, w int, b int, t int")
    got = {r.g: r for r in stats.paired_bootstrap(df, "g", ["i"], "b", "t", "w", 50).collect()}
    assert got["x"].delta_rel == 1.0 and got["x"].p_boot < 0.05
    assert got["same"].delta == 0.0 and got["same"].p_boot > 0.9
    again = stats.paired_bootstrap(df.repartition(7), "g", ["i"], "b", "t", "w", 50).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got.values()))
    p = {r.g: r.p_wilcoxon for r in stats.wilcoxon(df, "g", "b", "t").collect()}
    assert p["x"] < 1e-6 and p["same"] == 1.0


def test_curve_delta(spark):
    rows = [("p", i, s, 9, 10, 10, 10, 10) for i in range(40) for s in (0, 1)]  # own 10 % better than the control at the top, equal at the reference
    df = frame(spark, [(k, i, s, ot, orf, ct, cr, b) for k, i, s, ot, orf, ct, cr, b in rows], "who string, item int, seed int, own_top int, own_ref int, con_top int, con_ref int, base int")
    r = stats.curve_delta(df, "who", ["item"], "seed", ("own_ref", "own_top"), ("con_ref", "con_top"), "base", 20).first()
    assert (r.delta, r.ci_lo, r.ci_hi) == (0.1, 0.1, 0.1)


def test_queue_and_second_test(spark):
    q = ledger.queue_rollup(frame(spark, [("done", 2.0, 4.0), ("done", 2.0, 2.0), ("hold", 1.0, None)], "status string, est double, actual double"), "status", "est", "actual")
    assert {r.status: (r.n, r.ratio) for r in q.collect()} == {"done": (2, 1.5), "hold": (1, None)}
    base = frame(spark, [(1, 5, "a", "test"), (1, 6, "b", "train")], "speaker int, session int, chunk string, part string")
    corpus = frame(spark, [(1, 5, "a", 0.95), (1, 5, "c", 0.75), (1, 5, "d", 0.5), (1, 6, "b", 0.99)], "speaker int, session int, chunk string, quality double")
    got = splits.second_test_set(base, corpus, "speaker", "session", "chunk", "quality").collect()
    assert {(r.chunk, r.hq) for r in got} == {("a", True), ("c", False)}


def test_replace_incumbent(spark):
    def run(gains, lack=False):
        rows = [("inc", s, 0.10) for s in "abcd"] + [("new", s, 0.10 + g) for s, g in zip("abcd", gains)][: 3 if lack else 4]
        df = frame(spark, [(80, *r) for r in rows], "budget int, cand string, who string, d double")
        return decide.replace_incumbent(df, ["budget"], "cand", "who", "d", F.col("cand") == "inc").first()

    assert run([0.02, 0.02, 0.02, -0.01]).winner == "new"
    assert run([0.05, 0.05, -0.01, -0.01]).winner == "inc"
    assert run([0.009] * 4).winner == "inc"
    assert run([0.02] * 4, lack=True).winner is None


def test_verdicts(spark):
    v = lambda rows: decide.curve_verdict(frame(spark, rows, "delta double, ci_lo double, ci_hi double")).first()[0]
    assert v([(0.1, 0.05, 0.2), (0.03, 0.01, 0.1)]) == "limits"
    assert v([(0.0, -0.01, 0.01)]) == "does not limit"
    assert v([(0.1, 0.05, 0.2)]) == v([]) == "undecided"


def test_jobs(spark):
    jobs = frame(spark, [("a", [], "failed"), ("b", ["a"], "pending"), ("c", ["b"], "pending"), ("d", [], "done"), ("e", ["d"], "pending"), ("f", [], "hold")], "id string, deps array<string>, status string")
    got = {r.id: (r.ready, r.dead) for r in decide.job_states(jobs).collect()}
    assert got["b"] == (False, True) and got["c"] == (False, True) and got["e"] == (True, False) and got["f"] == (False, False)
    chain = [(str(i), [str(i - 1)] if i else [], "pending" if i else "failed") for i in range(130)] + [("x", ["129", "y"], "pending"), ("y", [], "done"), ("z", ["y", "gone"], "pending")]
    far = {r.id: (r.ready, r.dead) for r in decide.job_states(frame(spark, chain, "id string, deps array<string>, status string")).collect()}
    assert all(far[str(i)] == (False, True) for i in range(1, 130)) and far["x"] == (False, True) and far["z"] == (False, False)
    assert decide.finished(decide.job_states(frame(spark, chain[:130], "id string, deps array<string>, status string"))).first()[0] is True
    many = [{"id": str(i), "deps": [], "prio": 0, "est": 5.0} for i in range(12)]
    assert decide.simulate_schedule(many, 1) == 60.0 and decide.simulate_schedule(many, 4) == 15.0
    with pytest.raises(ValueError):
        decide.simulate_schedule([{"id": "x", "deps": ["y"], "prio": 0, "est": 1.0}], 1)


def test_ledger(spark):
    a, b = frame(spark, [(1, "x"), (2, "y")], "k int, v string"), frame(spark, [(2, "z"), (3, "w")], "k int, v string")
    assert {tuple(r) for r in ledger.upsert(a, b, ["k"]).collect()} == {(1, "x"), (2, "z"), (3, "w")}
    s = ledger.compare_sets(a, b, "k").first()
    assert (s.n_both, s.only_a, s.only_b, s.equal, s.disjoint, s.a_in_b) == (1, 1, 1, False, False, False)
    log = frame(spark, [("c", False, 9), ("c", True, 3), ("d", False, 1), ("d", False, 2)], "k string, ok boolean, ts int").withColumn("v", F.col("ts"))
    assert {(r.k, r.v) for r in ledger.latest_success(log, ["k"], F.col("ok"), "ts", ["v"]).collect()} == {("c", 3), ("d", 2)}
    names = frame(spark, [("chunks-00003.parquet",), ("chunks-00010.parquet",)], "n string")
    assert ledger.next_shard(names, "n").first()[0] == 11 and ledger.next_shard(names.filter("false"), "n").first()[0] == 0


def test_checks(spark):
    df = frame(spark, [(1, "train", 1.0), (1, "test", None)], "g int, p string, q double")
    got = {r.check: r.offenders for r in checks.all_checks(checks.count_offenders(df, {"q": F.col("q") > 0}), checks.unique_key(df, ["g"]), checks.disjoint_groups(df, "g", "p")).collect()}
    assert got == {"q": 1, "unique_key": 1, "disjoint": 1}


def test_io(spark, tmp_path):
    df = io.coerce(frame(spark, [("x", "7")], "chunk_id string, knesset string"), io.RUN_LOG)
    assert df.schema.names == io.RUN_LOG.names and df.first().knesset == 7
    assert io.coerce(spark.createDataFrame([], "a int"), io.RUN_LOG).count() == 0
    (tmp_path / "log").mkdir()
    (tmp_path / "log/run.jsonl").write_text('{"chunk_id": "a", "arm": "A"}\n{"chunk_id": "b", "ar')
    (tmp_path / "log/verify_x.jsonl").write_text('{"chunk_id": "v"}\n')
    assert [r.chunk_id for r in io.read_run_log(spark, str(tmp_path / "log")).collect()] == ["a"]
    docs = '{"session_id": 1, "text": "ab cd", "segments": [{"text": "ab", "words": [{"word": "ab", "start": 0, "end": 1, "probability": 1}]}, {"text": "XX", "words": [{"word": "XX", "start": 1, "end": 2, "probability": 1}]}], "map": [{"start_char": 0}, {"start_char": 3}]}'
    (tmp_path / "doc.json").write_text(docs)
    words = io.words_of_sessions(io.read_session_docs(spark, str(tmp_path / "doc.json"))).orderBy("seg").collect()
    assert [(w.word, w.a, w.b, w.offset_ok) for w in words] == [("ab", 0, 2, True), ("XX", 3, 5, False)]
    nested = frame(spark, [((1, (2,)),)], "x struct<a: int, b: struct<c: int>>")
    assert io.flatten(nested).columns == ["x.a", "x.b.c"]
    assert io.formatted(frame(spark, [(0.1234567,)], "v double")).first().v == "0.123457"
    got = io.transcribe(frame(spark, [("a", b"xy"), ("b", None), ("c", b"!")], "chunk_id string, audio binary"), "audio", lambda x: x.decode() if x != b"!" else 1 / 0).collect()
    assert [(r.hypothesis, (r.error or "")[:8]) for r in got] == [("xy", ""), (None, "no audio"), (None, "ZeroDivi")]
    pages = io.pages(lambda off, n: [{"id": i} for i in range(off, min(off + n, 25))], spark, io.T.StructType.fromDDL("id bigint"), 25, 10)
    assert pages.count() == 25


def test_streaming(spark, tmp_path):
    from plenora.streaming import ingest

    src = spark.range(60).select((F.col("id") % 5).alias("k"), F.timestamp_seconds(F.col("id") * 600).alias("ts"), (F.col("id") % 3 > 0).alias("good"), F.col("id").alias("v"))
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = ingest.file_stream(spark, str(tmp_path / "in"), src.schema, files_per_trigger=1)
    q = ingest.keep_latest(stream, str(tmp_path / "out"), str(tmp_path / "ck"), ["k"], F.col("good"), "ts", ["v"])
    q.awaitTermination(120)
    want = {(r.k, r.v) for r in ledger.latest_success(src, ["k"], F.col("good"), "ts", ["v"]).collect()}
    assert sorted((r.k, r.v) for r in ingest.latest_table(spark, str(tmp_path / "out")).collect()) == sorted(want)
    q = ingest.tumbling_counts(ingest.file_stream(spark, str(tmp_path / "in"), src.schema), "ts", "1 hour", "1 minute").writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("tumbled").collect()} == {tuple(r) for r in ingest.tumbling_counts(src, "ts", "1 hour", "1 minute").collect()}


def test_plans_stay_declarative(spark):
    df = point_in_span(spark.range(10).selectExpr("id k", "id * 1.0 t"), spark.range(10).selectExpr("id k", "id * 1.0 s", "id + 1.0 e"), ["k"], "t", "s", "e", 1.0)
    assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()
