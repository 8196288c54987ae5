import itertools
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from plenora.llm import queries as Q
from plenora.llm.canon import Canoniser, canonical, look_alike_pairs, look_alike_rows
from plenora.llm.groupsplit import assign_splits, components, label_profiles, min_cost_quotas, part_of, parted_groups, plan_rows, round_components
from plenora.llm.leakage import holds_passage, leaks, seeds, tiles
from plenora.llm.names import _lgamma, _near, attribute, learn_lexicon, linked_pairs, surname_neighbours
from plenora.llm.packing import first_fit_decreasing, pack, token_counts
from plenora.llm.sampling import cohort_weights, consistent_sample
from plenora.llm.truncation import prefix_copies, scan_texts, tail_uses, truncated
from plenora.llm.turns import collapse_runs
from plenora.operators.segments import usable_spans
from tests.conftest import DATA
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_matches_sql(spark, name):
    same(spark, Q.QUERIES[name], Q.SQL[name], f"{DATA}/sf0.001")


# ---- runs -------------------------------------------------------------------


def brute_runs(rows):
    out = {}
    for s in {r[0] for r in rows}:
        run = None
        for _, a, b, name, sid, voice in sorted((r for r in rows if r[0] == s), key=lambda r: (r[1], r[2], r[3])):
            sid = sid or 0
            if run and (run["sid"] == sid if run["sid"] > 0 and sid > 0 else run["voice"] is not None and run["voice"] == voice):
                run["last"], run["n"] = name, run["n"] + 1
            else:
                if run:
                    out.setdefault(s, []).append((run["first"], run["last"], run["n"]))
                run = {"first": name, "last": name, "n": 1}
            run["sid"], run["voice"] = sid, voice
        out.setdefault(s, []).append((run["first"], run["last"], run["n"]))
    return out


@pytest.mark.parametrize("batch", [1, 3, 10_000])
def test_runs_against_brute_force(spark, batch):
    rnd = random.Random(batch)
    rows = [(rnd.randrange(3), float(rnd.randrange(0, 5000)), 0.0, f"f{i:04d}", rnd.choice([0, 0, 7, 8, None]), rnd.choice([None, 1, 2])) for i in range(400)]
    rows += [(9, 5.0, 0.0, f"t{i}", 7, 1) for i in range(40)]  # ties, one session of equal rows
    rows = [(s, a, a + 1 + i % 3, n, sid, v) for i, (s, a, _, n, sid, v) in enumerate(rows)]
    df = spark.createDataFrame(rows, "session long, start double, end double, filename string, speaker_id long, local_speaker_id long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {}
        for r in collapse_runs(df).collect():
            got.setdefault(r.session, []).append((r.first_filename, r.last_filename, r.n_rows))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    want = brute_runs(rows)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert collapse_runs(df.filter("false")).count() == 0


def test_usable_spans(spark):
    rows = [("a", 1, 0.0, 1.0, 1), ("a", 1, 0.0, 5.0, 2), ("b", 1, 3.0, 3.0, 1), ("c", 1, None, 3.0, 1), ("d", None, 0.0, 1.0, 1), (None, 1, 0.0, 1.0, 1), ("e", 1, float("nan"), 1.0, 1)]
    df = spark.createDataFrame(rows, "filename string, session long, start double, end double, v int").select("*", F.timestamp_seconds("v").alias("ingested_at"))
    assert [(r.filename, r.end) for r in usable_spans(df).collect()] == [("a", 5.0)]


# ---- samples ----------------------------------------------------------------


def _sample(df, target=20.0, state=None):
    got, state = consistent_sample(df, "chunk_id", "speaker_id", "batch", target, state=state)
    return {r.chunk_id for r in got.collect()}, state


def test_sample_keeps_members(spark):
    rows = [(f"c{i}", i % 3 if i % 10 else None, 1 + i * 6 // 600) for i in range(600)] + [("c1", 1, 6), (None, 1, 1), ("x", 1, None)]
    df = spark.createDataFrame(rows, "chunk_id string, speaker_id int, batch int")
    before, state = set(), None
    for b in (1, 2, 4, 6):
        members, state = _sample(df.filter(f"batch <= {b}"), state=state)
        assert before <= members
        before = members
    again, _ = _sample(df.repartition(9).orderBy(F.desc("chunk_id")).withColumn("weights", F.lit(0)))
    assert again == before and None not in before and "x" not in before
    # Many rows come late for the first delivery: nobody leaves, at any later time.
    late = df.union(spark.createDataFrame([(f"late{i}", 1, 1) for i in range(900)], "chunk_id string, speaker_id int, batch int"))
    after, state = _sample(late, state=state)
    assert before <= after and after <= _sample(late, state=state)[0]
    assert _sample(df.filter("false"))[0] == set()


def test_sample_size_follows_the_target(spark):
    rows = [(f"s{k}-{i}", k, 1 + (i >= 15) + (i >= 1000)) for k in range(8) for i in range(2000)]
    members, _ = _sample(spark.createDataFrame(rows, "chunk_id string, speaker_id int, batch int"))
    assert 8 * 30 < len(members) < 8 * 60  # 15 + 985 * 20 / 1000 + 1000 * 20 / 2000 expected of each


def test_cohort_weights_never_fall(spark):
    first = spark.createDataFrame([("s", b) for b in (1, 2, 3) for _ in range(10 * b)], "g string, b int")
    w = {r.b: r.weight for r in cohort_weights(first, "g", "b", 5.0).collect()}
    assert w == {1: 0.5, 2: 5 / 30, 3: 5 / 60}
    state = cohort_weights(first.filter("b < 3"), "g", "b", 5.0)
    more = first.union(spark.createDataFrame([("s", 1)] * 90, "g string, b int"))
    assert {r.b: r.weight for r in cohort_weights(more, "g", "b", 5.0, state).collect()} == {1: 0.5, 2: 5 / 30, 3: 5 / 150}


# ---- splits -----------------------------------------------------------------


def test_parts(lit):
    assert [lit(part_of(F.lit(x).cast("string"))) for x in ("Train", " training ", "VAL", "dev", "testing", None, "holdout", "")] == ["train", "train", "dev", "dev", "test", None, None, None]


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(50)]
    boss = {}

    def find(x):
        while boss.setdefault(x, x) != x:
            x = boss[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        boss[max(x, y)] = min(x, y)
    want = {x: find(x) for e in edges for x in e if e[0] != e[1]}
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.component for r in components(df, "a", "b").collect()} == want
    assert {r.node: r.component for r in components(df, "a", "b", one_task=0).collect()} == want
    assert components(df.filter("false"), "a", "b").count() == 0


def test_splits_never_part_groups(spark):
    rnd = random.Random(4)
    rows = [(f"c{i}", f"2020-01-01_{rnd.randrange(60):07d}", rnd.choice([0, 7, *range(100, 160)]) if i % 3 else 0, rnd.choice(["train"] * 8 + ["dev", "Test", None, "odd"])) for i in range(900)]
    rows += [(None, None, 0, None), ("lone", None, None, "dev"), rows[0], rows[0]]
    plan = spark.createDataFrame(rows, "chunk_id string, session string, speaker_id long, part string")
    got = assign_splits(plan_rows(plan), {"train": 0.8, "dev": 0.1, "test": 0.1}).toPandas()
    assert len(got) == len(rows) and got.split.notna().all()
    for key in ("meeting", "speaker"):
        assert got[got[key].notna()].groupby(key).split.nunique().max() == 1
    again = assign_splits(plan_rows(plan.repartition(5)), {"train": 0.8, "dev": 0.1, "test": 0.1}).toPandas()
    assert dict(zip(got.component, got.split)) == dict(zip(again.component, again.split))
    bad = {(r.group_kind, r.group_id) for r in label_profiles(plan_rows(plan)).filter("n_parts > 1").collect()}
    assert bad and all(k in ("session", "speaker") for k, _ in bad)
    found = parted_groups(assign_splits(plan_rows(plan), {"train": 0.8, "dev": 0.1, "test": 0.1})).collect()
    assert {(r.group_kind, r.group_id) for r in found} == bad and all(r.n_splits == 1 for r in found)
    assert assign_splits(plan_rows(plan.filter("false")), {"train": 1.0}).count() == 0


def test_quotas_are_met_as_well_as_whole_components_allow():
    each, count = np.array([279.0, 238.0, 89.0, 68.0]), np.ones(4, int)
    quota, cost = np.array([539.2, 67.4, 67.4]), np.full((4, 3), 0.5)
    flow = min_cost_quotas(each, cost, quota, 4.0)
    whole = round_components(flow, each, count, quota, cost, 4.0)
    assert (whole * each[:, None]).sum(0).tolist() in ([517, 68, 89], [517, 89, 68]) and (whole.sum(1) == 1).all()
    rnd = np.random.default_rng(1)
    for _ in range(20):
        each, quota = rnd.integers(1, 60, 7).astype(float), np.array([0.6, 0.2, 0.2])
        quota, cost = quota * each.sum(), rnd.random((7, 3))
        value = lambda w: (w * each[:, None] * cost).sum() + 4 * np.abs((w * each[:, None]).sum(0) - quota).sum()
        best = min(value(np.eye(3)[list(c)]) for c in itertools.product(range(3), repeat=7))
        assert value(round_components(min_cost_quotas(each, cost, quota, 4.0), each, np.ones(7, int), quota, cost, 4.0)) <= best * 1.15 + 8


def test_min_cost_flow_is_optimal():
    rnd = np.random.default_rng(0)
    for _ in range(40):
        n = int(rnd.integers(1, 4))
        size, cost = rnd.integers(1, 4, n).astype(float), rnd.integers(0, 5, (n, 3)).astype(float)
        quota = rnd.integers(0, 4, 3).astype(float)
        flow = min_cost_quotas(size, cost, quota, 4.0)
        assert np.allclose(flow.sum(1), size)
        worth = lambda f: (f * cost).sum() + 4.0 * np.maximum(f.sum(0) - quota, 0).sum()
        units = [b for b in range(n) for _ in range(int(size[b]))]
        best = np.inf
        for code in range(3 ** len(units)):
            f, c = np.zeros((n, 3)), code
            for b in units:
                f[b, c % 3] += 1
                c //= 3
            best = min(best, worth(f))
        assert worth(flow) == pytest.approx(best)


# ---- character forms --------------------------------------------------------


def test_canonical_forms():
    c = Canoniser()
    same_look = [("ＡＢ１", "AB1"), ("é", "é"), ("a​b­", "ab"), ("a b", "a b"), (" a ", "a"), ("Сор", "Cop"), ("צה״ל", 'צה"ל'), ("ג׳", "ג'"), ("a–b", "a-b"), ("שׁ", "שׁ"), ("װ", "וו"), ("ﬁ", "fi"), ("a͏́", "á"), ("…", "..."), ("й", "й")]
    for a, b in same_look:
        assert c(a) == c(b), (a, b)
    for a, b in [("A", "a"), ("שָׁלום", "שלום"), ("café", "cafe"), ("x²", "x2"), ("½", "1/2"), ("a b", "ab"), ("a.", "a"), ("①", "1")]:
        assert c(a) != c(b), (a, b)
    assert Canoniser(fold_case=True)("STRASSE") == Canoniser(fold_case=True)("straße")
    rnd = random.Random(0)
    for _ in range(300):
        s = "".join(chr(rnd.choice([rnd.randrange(32, 0x2FFF), rnd.randrange(0xFB00, 0xFFEF)])) for _ in range(8))
        assert c(c(s)) == c(s), ascii(s)


def test_look_alike_rows(spark):
    rows = [("1", "abc"), ("2", "ab​c"), ("3", "abc"), ("4", "ABC"), ("5", ""), ("6", "​"), ("7", None), (None, "abc "), ("8", "zz"), ("8", "z­z"), ("9", "long " * 5000), ("10", "long " * 5000)]
    got = {r.id for r in look_alike_rows(spark.createDataFrame(rows, "k string, t string").withColumn("id", F.lit(1)), "k", "t").collect()}
    assert got == {"1", "2", "3", "9", "10"}
    pairs = spark.createDataFrame([("a", "a"), ("a", "a​"), ("a", "b"), (None, "a"), ("a", None)], "l string, r string")
    assert look_alike_pairs(pairs, "l", "r").count() == 1
    assert spark.createDataFrame([(None,), ("",), ("Ａ",)], "t string").select(canonical(F.col("t")).alias("c")).collect()[2].c == "A"
    assert look_alike_rows(spark.createDataFrame([], "k string, t string"), "k", "t").count() == 0


# ---- packing ----------------------------------------------------------------


def test_first_fit_decreasing_against_plain_search():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 2, 5, 60):
        sizes = np.sort(rnd.integers(1, 101, n))[::-1]
        room, want = [], []
        for s in sizes:
            k = next((i for i, r in enumerate(room) if r >= s), len(room))
            if k == len(room):
                room.append(100)
            room[k] -= s
            want.append(k)
        assert first_fit_decreasing(sizes, 100).tolist() == want


def test_pack(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice([0, 3, 40, 99, 100, 101, 250, 1000])) for i in range(300)] + [(5, 60)] * 40 + [(None, 10), (None, 10)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long")
    got = pack(df, "doc_id", 100, group_size=64).toPandas()
    full = got[got.bin.notna()]
    assert full.n_tokens.sum() == sum(n for _, n in rows)
    assert full.groupby(["grp", "bin"]).n_tokens.sum().max() <= 100
    ordered = full.sort_values(["grp", "bin", "start"])
    gap = ordered.groupby(["grp", "bin"]).start.shift(-1) - ordered.start - ordered.n_tokens
    assert (gap.dropna() == 0).all()
    assert (got.bin.isna() == (got.n_tokens == 0)).all()
    small = full[full.n_tokens < 100]
    assert small.groupby(["doc_id", "copy", "grp"]).size().max() <= 2  # repeated ids only
    again = pack(df.repartition(7), "doc_id", 100, group_size=64).toPandas()
    key = lambda d: sorted(map(tuple, d.fillna(-1).to_numpy().tolist()))
    assert key(got) == key(again)
    assert pack(df.filter("false"), "doc_id", 100).count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello hello"), (2, ""), (3, None), (4, "<|endoftext|>"), (5, "word " * 20_000)], "id long, t string")
    got = dict(token_counts(df, "id", "t").collect())
    assert got[1] > 0 and got[2] == got[3] == 0 and got[4] > 1 and got[5] >= 20_000


# ---- leakage ----------------------------------------------------------------

WORDS = [a + b for a in "ba ke lo mi nu ra so tu ve wi".split() for b in "ta no pe ri su".split()]


def _sentence(rnd, n):
    return [rnd.choice(WORDS) + rnd.choice(WORDS) for _ in range(n)]


def test_tiles_cover_and_do_not_overlap():
    rnd = random.Random(7)
    for _ in range(50):
        a, b = (np.array([rnd.randrange(1, 5) for _ in range(rnd.randrange(1, 25))]) for _ in range(2))
        t = tiles(a, b)
        for p, q, n in t:
            assert (a[p : p + n] == b[q : q + n]).all()
        assert len({x for p, _, n in t for x in range(p, p + n)}) == sum(n for *_, n in t)
        assert len({x for _, q, n in t for x in range(q, q + n)}) == sum(n for *_, n in t)


@pytest.mark.parametrize("runs", [[11, -4, 7, -1, 5], [8, -3, 4, -1, 4, -1, 2]])
def test_passages_behind_dense_errors(runs):
    item = np.arange(1, sum(map(abs, runs)) + 1)
    right = np.concatenate([np.full(abs(n), n > 0) for n in runs])
    text = np.where(right, item, 0)
    assert holds_passage(text, item, np.ones(len(item), bool))
    assert not holds_passage(text[: runs[0] + 4], item, np.ones(len(item), bool))


def test_leaks(spark):
    rnd = random.Random(11)
    items = [(k, _sentence(rnd, 40)) for k in range(30)]
    noise = lambda n: " ".join(_sentence(rnd, n))
    docs, want = [], set()

    def add(text, k=None):
        docs.append((len(docs), text))
        if k is not None:
            want.add((len(docs) - 1, k))

    for k, w in items:
        add(f"{noise(60)} {' '.join(w[5:25])} {noise(30)}", k)  # in part
        hurt = [x if i % 8 != 3 else "other" for i, x in enumerate(w)]
        add(f"{noise(20)} {' '.join(hurt[:32])}", k)  # one in eight changed
        less = [x for i, x in enumerate(w) if i % 9 != 4]
        add(noise(9) + "\n[00:01:02] " + "\n[00:01:09] ".join(" ".join(less[i : i + 7]).upper() for i in range(0, 28, 7)), k)  # words missing, times between
        add(f"{' -- '.join(w[10:24])}", k)  # marks between
        add(f"{noise(30)} {' '.join(w[8:17])} {noise(30)}")  # nine words: a short quotation
        mixed = w[:]
        rnd.shuffle(mixed)
        add(" ".join(mixed))  # other order
        add(" ".join(w[0:6]) + " " + noise(40) + " " + " ".join(w[6:12]))  # in two places
    add(docs[0][1], 0)  # a copy
    docs += [(len(docs), None), (len(docs) + 1, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame([(k, " ".join(w)) for k, w in items] + [(99, None), (98, "short one")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leaks(d, "doc_id", "text", i, "item_id", "text").collect()}
    assert got == want
    twice = {(r.doc_id, r.item_id) for r in leaks(d.union(d), "doc_id", "text", i.union(i).withColumn("words", F.lit(1)), "item_id", "text").collect()}
    assert twice == want
    assert leaks(d.filter("false"), "doc_id", "text", i, "item_id", "text").count() == 0
    assert leaks(d, "doc_id", "text", i.filter("false"), "item_id", "text").count() == 0


def test_every_short_passage_holds_a_seed():
    rnd = random.Random(3)
    for _ in range(300):
        item = np.arange(1, 13, dtype=np.uint32)
        text = item.tolist()
        for _ in range(2):
            p, kind = rnd.randrange(len(text)), rnd.choice("change add drop".split())
            text[p : p + (kind != "add")] = [] if kind == "drop" else [900 + rnd.randrange(90)]
        pad = lambda x: np.concatenate([np.zeros(24, np.uint32), np.array(x, np.uint32), np.zeros(24, np.uint32)])
        if sum(x < 900 for x in text) >= 10:
            assert set(seeds(pad(item))[1].tolist()) & set(seeds(pad(text))[1].tolist())


def test_fixed_phrases_do_not_count(spark):
    rnd = random.Random(5)
    phrase = "please keep order in this room now"
    item = " ".join(_sentence(rnd, 8))
    docs = [(k, f"{' '.join(_sentence(rnd, 30))}. {phrase}. {' '.join(_sentence(rnd, 9))}") for k in range(40)] + [(100 + k, "same text again. " * 3) for k in range(50)]
    docs += [(200, f"x. {phrase}. {item} y"), (201, f"x. {item} and more. {phrase}")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame([(1, f"{phrase}. {item}"), (2, f"{phrase} {' '.join(_sentence(rnd, 12))}")], "item_id long, text string")
    assert leaks(d, "doc_id", "text", i, "item_id", "text").count() == 0  # eight words beside the phrase
    few = d.filter("doc_id >= 198 OR doc_id < 3")
    assert [tuple(r) for r in leaks(few, "doc_id", "text", i, "item_id", "text").collect()] == [(200, 1)]  # three texts make no phrase


@pytest.mark.parametrize("copies", [3, 6, 90])
def test_widely_leaked_short_sentences_are_found(spark, copies):
    rnd = random.Random(copies)
    item = ". ".join(" ".join(_sentence(rnd, 7)) for _ in range(3)) + "."
    docs = [(k, f"{' '.join(_sentence(rnd, 40))}. " + (item if k < copies else "") + f" {' '.join(_sentence(rnd, 20))}.") for k in range(200)]
    got = leaks(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", spark.createDataFrame([(7, item)], "item_id long, text string"), "item_id", "text")
    assert {r.doc_id for r in got.collect()} == set(range(copies))


# ---- truncation -------------------------------------------------------------


def test_sentences_of_a_widely_leaked_item_count(spark):
    rnd = random.Random(9)
    phrase = "please keep order in this room now"
    own = [" ".join(f"{w}{k}" for w in ("owl", "ran", "far", "off", "then")) for k in range(4)]
    item = ". ".join([*own, phrase])
    docs = [(k, f"{' '.join(_sentence(rnd, 30))}. {item}. {' '.join(_sentence(rnd, 9))}") for k in range(30)]
    docs += [(100 + k, f"{' '.join(_sentence(rnd, 30))}. {phrase}. {own[0].replace('0', '')} {k}") for k in range(20)]
    docs += [(200, f"{' '.join(_sentence(rnd, 30))}. {own[2]}. {own[3][:-6]} {phrase}")]  # ten words and a phrase
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {r.doc_id for r in leaks(d, "doc_id", "text", i, "item_id", "text").collect()} == set(range(30))


def test_prefix_copies(spark):
    rnd = random.Random(9)
    long = [" ".join(_sentence(rnd, 40)) for _ in range(60)]
    cut = [t[: 80 + 7 * i] for i, t in enumerate(long[:20])]
    rows = [(t,) for t in long + cut + cut[:5] + [cut[3] + " …", None, "", "tiny"]]
    letters = lambda x: scan_texts(spark.createDataFrame(x, "t string").distinct(), "t").filter("kind = 0").select("digest", "letters", "head")
    assert prefix_copies(letters(rows)).count() == 21  # twenty cut values, one of them also with a mark
    hot = [("same beginning of every text here " + t,) for t in long] * 3
    assert prefix_copies(letters(hot)).count() == 0
    nested = [("same beginning of every text here " + long[0][:k],) for k in range(300, 20, -1)]
    assert prefix_copies(letters(nested + hot)).count() == len(nested)


def test_truncated(spark):
    rnd = random.Random(1)
    vocab = ["budget", "committee", "minister", "reported", "district", "approved", "measure", "council", "delayed", "hearing"]
    sent = lambda: "The " + " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(6, 12))) + ". "
    rows, want = [], set()
    for i in range(300):
        t = "".join(sent() for _ in range(rnd.randrange(3, 9))).strip()
        if i % 3 == 0 and len(t) > 120:
            t = t[:120].rstrip(".")
            want.add(i)
        rows.append((i, t, "limited"))
    for i in range(300, 400):
        rows.append((i, " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(20, 60))), "spoken"))  # no punctuation by kind
    rows.append((400, " ".join(rnd.choice(vocab) for _ in range(20)) + " comm", "spoken"))
    rows.append((401, "The council appro�", "limited"))
    rows.append((402, "The budget committee approved the [...]", "limited"))
    want |= {400, 401, 402}
    rows += [(403, None, "limited"), (404, "", None), (405, "   ", "spoken")]
    got = {r.id for r in truncated(spark.createDataFrame(rows, "id long, t string, src string"), "id", "t", "src").filter("cut").collect()}
    assert got == want
    assert truncated(spark.createDataFrame([], "id long, t string, src string"), "id", "t", "src").count() == 0


def test_copies_of_a_cut_text_do_not_hide_it(spark):
    rnd = random.Random(4)
    vocab = ["budget", "committee", "minister", "reported", "district", "approved", "measure", "council", "delayed", "hearing"]
    text = lambda: " ".join("The " + " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(6, 12))) + "." for _ in range(rnd.randrange(3, 9)))
    rows = [(i, text(), "letters") for i in range(40)]
    cut = text()[:-1]
    rows += [(100 + i, cut, "letters") for i in range(200)]
    found = truncated(spark.createDataFrame(rows, "id long, t string, src string"), "id", "t", "src")
    assert {r.id for r in found.filter("array_contains(evidence, 'unclosed')").collect()} == set(range(100, 300))


def test_word_uses_count_each_text_once(spark):
    texts = ["the council met and then the coun"] * 9 + [f"number {k} of the council met and left for zanzibar in may zanz" for k in (1, 2, 3)] + [None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)
    try:
        words = scan_texts(df.distinct(), "t").filter("kind = 1").groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", "n_end", "n_last")])
        got = {r.word: (r.n, r.n_end, r.n_last) for r in words.collect()}
        tails = {r.tail: (r.n, r.n_longer) for r in tail_uses(words, spark.createDataFrame([("coun",), ("zzz",)], "tail string")).collect()}
        assert tails == {"coun": (0, 4), "zzz": (0, 0)}
        rows = spark.createDataFrame([(i, t, "spoken") for i, t in enumerate(texts)], "id long, t string, src string").repartition(4)
        found = {r.id for r in truncated(rows, "id", "t", "src").filter("array_contains(evidence, 'word')").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    assert got["coun"] == (0, 0, 1) and got["council"] == (4, 0, 0) and got["zanz"] == (0, 0, 3) and got["zanzibar"] == (3, 0, 0)
    assert found == set(range(12))


# ---- names ------------------------------------------------------------------


def test_near():
    assert all(_near(a, b) for a, b in [("abc", "abc"), ("abc", "abd"), ("abc", "ab"), ("abc", "abxc"), ("abc", "acb"), ("ab", "b")])
    assert not any(_near(a, b) for a, b in [("abcd", "bcda"), ("abc", "axx"), ("abcd", "ab"), ("abcd", "badc")])


def test_surname_neighbours(spark):
    names = ["kohavi", "kohav", "kohabi", "khoavi", "levi", "levy", "abcdef", "bcdefa", "ab"]
    got = {(r.s, r.near) for r in surname_neighbours(spark.createDataFrame([(n,) for n in names], "s string")).collect()}
    assert got == {(a, b) for a in names for b in names if a != b and min(len(a), len(b)) >= 2 and _near(a, b)}


def test_names(spark):
    rows = [
        (1, 7, "David Kohavi"), (2, 7, "Kohavi David"), (3, 0, "Kohavi, David"), (4, 0, "Dr. David (Dudu) Kohavi"), (5, 0, "Dudu Kohabi"), (6, 0, "D. Kohavi"), (7, 0, "DavidKohavi"), (8, 0, "Davdi Kohavi"),
        (9, 8, "Ruth Kohavi"), (10, 0, "R. Kohavi"), (11, 0, "David Somebody"), (12, 0, "David Somebodi"), (13, 0, None), (14, 0, ""), (15, 0, "David Kohavi"), (16, 8, "Kohavi Ruth"), (17, 0, "!!"),
    ]
    df = spark.createDataFrame(rows, "id long, person long, variant string")
    roster = spark.createDataFrame([("David",), ("Ruth",)], "first_name string")
    lex = learn_lexicon(df, "variant", roster)
    assert lex.of == {"david": "david", "ruth": "ruth", "dudu": "david"} or "dudu" in lex.of
    found = attribute(df, "id", "variant", "person", None, lex)
    by = {}
    for r in found.collect():
        by.setdefault(r.entity, set()).add(r.row)
    groups = sorted(by.values(), key=min)
    assert groups == [{1, 2, 3, 4, 5, 6, 7, 8, 15}, {9, 10, 16}, {11, 12}]
    pairs = {(r.a, r.b) for r in linked_pairs(found).collect()}
    assert (1, 2) not in pairs and (9, 16) not in pairs and (1, 3) in pairs and (3, 4) in pairs and (11, 12) in pairs
    assert len(pairs) == 36 - 1 + 2 + 1
    plain = {(r.a, r.b) for r in linked_pairs(found, hot_rows=3).collect()}
    assert plain == pairs
    assert linked_pairs(attribute(df.filter("false").withColumn("n_seen", F.lit(None).cast("int")), "id", "variant", "person", "n_seen", lex)).count() == 0


def _entities_of(spark, names):
    df = spark.createDataFrame([(k, 0, n, 1) for k, n in enumerate(names)], "id long, person long, variant string, n_seen int")
    lex = learn_lexicon(df, "variant", spark.createDataFrame([("David",)], "first_name string"))
    return {r.row: r.entity for r in attribute(df, "id", "variant", "person", "n_seen", lex).collect()}


def test_two_frequent_neighbours_stay_two(spark):
    got = _entities_of(spark, ["David Kohavi"] * 500 + ["David Kohabi"] * 499 + ["David Kohavy"])
    assert len(set(got.values())) == 2 and got[999] == got[0] != got[500]


def test_moves_are_followed_to_their_end(spark):
    got = _entities_of(spark, ["David Kohavi" + "abcdefghijkl"[:k] for k in range(12)])
    assert len(set(got.values())) == 1


def test_lgamma(spark):
    import math

    got = spark.range(1, 400).select("id", _lgamma(F.col("id").cast("double")).alias("g")).collect()
    assert all(abs(r.g - math.lgamma(r.id)) < 1e-8 * max(1, abs(r.g)) for r in got)


def test_rare_names_are_known_at_any_size(spark):
    rows = [(f"David Kohavi{chr(97 + k % 26)}",) for k in range(10_000)] + [('Zelda "Zuzi" Brandt',), ('Brandt "Zuzi" Zelda',), ("David (Dudu) Kohavi",)]
    roster = spark.createDataFrame([("David",)] * 10_000 + [("Zelda",)], "first_name string")
    lex = learn_lexicon(spark.createDataFrame(rows, "variant string"), "variant", roster)
    assert lex.of == {"david": "david", "zelda": "zelda", "dudu": "david", "zuzi": "zelda"}
    form = Canoniser(fold_case=True, strip_marks=True)
    assert lex.readings("Zuzi Brandt", form) == [("strong", "zelda", "brandt", -1.0)]
    assert lex.readings("ZeldaBrandt", form) == [("weak", "zelda", "brandt", -3.0)] and lex.readings("BrandtZelda", form) == [("weak", "zelda", "brandt", -3.0)]


# ---- the queries as a whole -------------------------------------------------


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_runs(spark, name):
    df = Q.QUERIES[name](spark, f"{DATA}/sf0.001")
    assert df.count() >= 0


def test_forms_agree_with_normalisation(spark):
    c = Canoniser()
    for t in spark.read.parquet(f"{DATA}/sf0.001/benchmark.parquet").select("text").toPandas().text:
        assert unicodedata.is_normalized("NFC", c(t))


def test_edges_of_the_inputs(spark):
    """Null ids and texts, an empty and a very long text, repeated rows and columns that clash with inner names."""
    rnd = random.Random(21)
    item = " ".join(_sentence(rnd, 30))
    long = " ".join(_sentence(rnd, 40_000)) + f". {item}"
    docs = [(1, long), (2, None), (3, ""), (None, item), (5, item), (5, item), (6, " \n ")]
    clash = lambda df: df.withColumns({c: F.lit(c) for c in ("unit", "digest", "item", "key", "words", "pair", "tail", "form", "raw", "__h", "ids")})
    d = clash(spark.createDataFrame(docs, "doc_id long, text string").withColumn("source", F.lit(None).cast("string")))
    got = leaks(d, "doc_id", "text", clash(spark.createDataFrame([(9, item), (None, item), (8, None)], "item_id long, text string")), "item_id", "text")
    assert {tuple(r) for r in got.collect()} == {(1, 9), (5, 9)}
    cut = truncated(d, "doc_id", "text", "source").collect()
    assert sorted(str(r.doc_id) for r in cut) == ["1", "5", "5", "None"] and d.columns[:2] == ["doc_id", "text"]
    packed = pack(token_counts(d, "doc_id", "text"), "doc_id", 2048).collect()
    assert sum(r.bin is None for r in packed) == 2 and max(r.n_tokens for r in packed) <= 2048 and sum(r.doc_id == 5 for r in packed) == 2
    same_look = clash(spark.createDataFrame([("a", "x\u00a0y"), ("b", "x y"), ("b", "x y"), (None, "x y"), ("c", None), ("e", "")], "id string, text string"))
    assert {r.id for r in look_alike_rows(same_look, "id", "text").collect()} == {"a", "b"}
    assert look_alike_rows(same_look.filter("false"), "id", "text").count() == 0
    none = d.filter("false")
    assert truncated(none, "doc_id", "text", "source").count() == 0 and pack(token_counts(none, "doc_id", "text"), "doc_id", 2048).count() == 0
