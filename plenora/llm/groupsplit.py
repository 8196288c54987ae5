"""Train, dev and test splits in which related records never part.

Records that share a meeting or a person form connected components; a
component goes into one split as a whole. Components of the same size and label
profile are bundled, a min-cost flow fills the splits' quotas from the bundles
(cost: rows that leave the part they had, and rows beyond a quota), the flow is
rounded to whole components at the least cost that moves and swaps of components
find, and the members of a bundle take their split by the order of their hashes.
Only the bundles, whose number is bounded by the kinds of size and profile,
reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenora.operators.chunked import running_sum
from plenora.operators.skew import hot_keys, salted_join
from plenora.session import cut_lineage, written

PARTS = ("train", "dev", "test")
# Spellings that plainly mean a part, in lower case.
SPELLINGS = {
    "train": ["train", "training", "trn", "tr", "train set", "training set", "train_set", "trainset"],
    "dev": ["dev", "devel", "development", "val", "valid", "validation", "validate", "dev set", "dev_set", "validation set", "val set"],
    "test": ["test", "testing", "tst", "test set", "test_set", "testset", "tests"],
}
#: Sizes up to this are bundled exactly, larger ones by sixteenths of an octave.
EXACT_SIZE = 64
#: So many edges of a spanning forest are joined up in one task; more take star rounds.
ONE_TASK_EDGES = 1_000_000


def part_of(col: Column) -> Column:
    """The part a spelling means; null for null and for anything that is not plainly one."""
    bare = F.lower(F.regexp_replace(col, r"^[\s\p{Z}\p{Cf}\p{Punct}]+|[\s\p{Z}\p{Cf}\p{Punct}]+$", ""))
    out = F.lit(None).cast("string")
    for part, names in SPELLINGS.items():
        out = F.when(bare.isin(names), part).otherwise(out)
    return out


def meeting_of(col: Column) -> Column:
    """The number after the last underscore of a session string; null where there is none."""
    digits = F.regexp_extract(col, r"_\s*([0-9]+)\s*$", 1)
    return F.when(digits != "", digits).try_cast("bigint")


def plan_rows(plan: DataFrame) -> DataFrame:
    """chunk_id, meeting, speaker (null unless > 0), part of each row of a plan table."""
    return plan.select("chunk_id", meeting_of(F.col("session")).alias("meeting"), F.when(F.col("speaker_id") > 0, F.col("speaker_id")).alias("speaker"), part_of(F.col("part")).alias("part"))


def label_profiles(rows: DataFrame, *more: Column) -> DataFrame:
    """Per meeting and per person: rows in all and in each part, and the number of parts.

    A map-side aggregate over one exploded copy; a person with a third of all
    rows is one row per task after it. Output: group_kind, group_id, n_rows,
    n_train, n_dev, n_test, n_parts and ``more`` aggregates.
    """
    each = rows.select("*", F.explode(F.array(F.struct(F.lit("session").alias("k"), F.col("meeting").alias("i")), F.struct(F.lit("speaker").alias("k"), F.col("speaker").alias("i")))).alias("g")).filter("g.i IS NOT NULL")
    counts = [F.count_if(F.col("part") == p).alias(f"n_{p}") for p in PARTS]
    per = each.groupBy(F.col("g.k").alias("group_kind"), F.col("g.i").alias("group_id")).agg(F.count(F.lit(1)).alias("n_rows"), *counts, *more)
    return per.withColumn("n_parts", sum(((F.col(f"n_{p}") > 0).cast("int") for p in PARTS), F.lit(0)))


def forest(edges: DataFrame, last: bool = False) -> DataFrame:
    """(u, v) of long ids, v < u: each partition's edges by union-find reduced to the links of its nodes to the least node
    that they are joined to, so never more edges than nodes. ``last``: the nodes' own components, least nodes included."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        boss: dict[int, int] = {}

        def find(x: int) -> int:
            while (y := boss.setdefault(x, x)) != x:
                boss[x] = x = boss.setdefault(y, y)
            return x

        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x, y = find(x), find(y)
                if x != y:
                    boss[max(x, y)] = min(x, y)
        links = [(x, r) for x in boss if (r := find(x)) != x or last]
        for k in range(0, len(links), 100_000):
            part = links[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], pa.int64()), pa.array([r for _, r in part], pa.int64())], names=["u", "v"])

    return edges.mapInArrow(work, "u long, v long")


def star_rounds(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components (node, component) by alternating large-star and small-star rounds.

    Each round takes minima (map-side aggregates) and one join, in which hubs
    are salted, and is written to the checkpoint folder. Stops when a round
    changes nothing; raises if ``max_rounds`` do not suffice.
    """
    cur, mark = cut_lineage(links.union(links.select("v", "u")).distinct()), None
    for _ in range(max_rounds):
        near = cur.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        hubs = hot_keys(cur, "u", cur.count())
        large = salted_join(cur, near, "u", hubs, ["v"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Every row now points from a node to a smaller one (or itself, dropped).
        down = large.filter("v < u")
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).distinct()
        sym = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
        cur = cut_lineage(sym.union(sym.select("v", "u")))
        state = cur.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == mark:
            return cur.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("u")).alias("component"))
        mark = state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def components(edges: DataFrame, a: str, b: str, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """Connected components of an undirected graph of long ids: node, component (its least node).

    Every partition first reduces its edges to a spanning forest. If no more
    than ``one_task`` edges are left, one task joins them up; otherwise star
    rounds do, with the same result.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct()
    links = written(forest(e))
    if links.count() <= one_task:
        return forest(links.coalesce(1), last=True).select(F.col("u").alias("node"), F.col("v").alias("component"))
    return star_rounds(links)


def row_components(rows: DataFrame) -> DataFrame:
    """``rows`` with ``component``: shared by all rows linked through meetings and persons.

    A row with neither is a component of its own, named by its chunk_id.
    """
    m, s = F.col("meeting") * 2, F.col("speaker") * 2 + 1
    linked = rows.select(F.coalesce(m, s).alias("a"), F.coalesce(s, m).alias("b")).filter("a IS NOT NULL").distinct()
    comp = written(components(linked, "a", "b"))
    own = rows.withColumn("__node", F.coalesce(m, s))
    hubs = hot_keys(own, "__node", own.count())
    named = salted_join(own, comp.withColumnRenamed("node", "__node"), "__node", hubs, ["chunk_id"], "left")
    alone = F.concat(F.lit("row:"), F.coalesce("chunk_id", F.lit("")))
    return named.withColumn("component", F.when(F.col("__node").isNull(), alone).otherwise(F.coalesce("component", "__node").cast("string"))).drop("__node")


def min_cost_quotas(size: np.ndarray, cost: np.ndarray, quota: np.ndarray, over: float) -> np.ndarray:
    """Flow (bundles x splits) of least cost: ``size[b]`` units leave bundle b, a unit costs
    ``cost[b, s]`` in split s and ``over`` more beyond ``quota[s]``.

    Successive shortest paths; as there are few splits, a path is a bundle's
    entry into a split, moves of earlier flow between splits, and an exit.
    """
    n, k = cost.shape
    flow, left, room = np.zeros((n, k)), size.astype(float).copy(), quota.astype(float).copy()
    eps = 1e-9
    while left.max(initial=0) > eps:
        # Cheapest way to pass one unit from split s on to split t, and who moves.
        move, who = np.full((k, k), np.inf), np.zeros((k, k), int)
        for s in range(k):
            has = flow[:, s] > eps
            if has.any():
                for t in range(k):
                    if t != s:
                        d = np.where(has, cost[:, t] - cost[:, s], np.inf)
                        who[s, t] = int(d.argmin())
                        move[s, t] = d[who[s, t]]
        exits = np.where(room > eps, 0.0, over)
        dist, way = exits.copy(), [[s] for s in range(k)]
        for _ in range(k):
            for s in range(k):
                for t in range(k):
                    if s not in way[t] and move[s, t] + dist[t] < dist[s] - eps:
                        dist[s], way[s] = move[s, t] + dist[t], [s, *way[t]]
        live = np.flatnonzero(left > eps)
        total = cost[live] + dist
        i, s0 = np.unravel_index(int(total.argmin()), total.shape)
        b, path = int(live[i]), way[s0]
        amount = left[b]
        for s, t in zip(path, path[1:]):
            amount = min(amount, flow[who[s, t], s])
        if room[path[-1]] > eps:
            amount = min(amount, room[path[-1]])
        flow[b, path[0]] += amount
        for s, t in zip(path, path[1:]):
            flow[who[s, t], s] -= amount
            flow[who[s, t], t] += amount
        room[path[-1]] -= min(amount, max(room[path[-1]], 0.0))
        left[b] -= amount
    return flow


def _descend(whole: np.ndarray, each: np.ndarray, quota: np.ndarray, cost: np.ndarray, over: float) -> float:
    """Lower the cost of a plan in place by moves of a component to another split and swaps of two, as far as they go."""
    k, shift = len(quota), each[:, None] * cost  # what a component of the bundle costs in each split
    load = (whole * each[:, None]).sum(0)
    while True:
        best, do, off = -1e-6, None, np.abs(load - quota)
        for s in range(k):
            for t in range(k):
                src, dst = np.flatnonzero(whole[:, s] > 0), np.flatnonzero(whole[:, t] > 0)
                if s == t or not len(src):
                    continue
                miss = lambda d: over * (np.abs(load[s] - d - quota[s]) + np.abs(load[t] + d - quota[t]) - off[s] - off[t])  # noqa: B023, E731
                gain = shift[src, t] - shift[src, s] + miss(each[src])
                i = int(gain.argmin())
                if gain[i] < best:
                    best, do = gain[i], ((int(src[i]), s, t),)
                if len(dst) and s < t:
                    both = (shift[src, t] - shift[src, s])[:, None] + (shift[dst, s] - shift[dst, t])[None, :] + miss(each[src][:, None] - each[dst][None, :])
                    i, j = np.unravel_index(int(both.argmin()), both.shape)
                    if both[i, j] < best:
                        best, do = both[i, j], ((int(src[i]), s, t), (int(dst[j]), t, s))
        if do is None:
            return float((whole * shift).sum() + over * off.sum())
        for x, p, q in do:
            whole[x, p] -= 1
            whole[x, q] += 1
            load[p] -= each[x]
            load[q] += each[x]


def round_components(flow: np.ndarray, each: np.ndarray, count: np.ndarray, quota: np.ndarray, cost: np.ndarray, over: float, kicks: int = 60) -> np.ndarray:
    """Whole components per bundle and split from a flow in rows, at the flow's costs.

    Floors first; the rest one by one, the largest first, where they cost least;
    then moves and swaps while they lower the cost (rows that leave their part,
    and ``over`` for each row by which a split misses its quota), begun again
    from ``kicks`` plans in which three components were moved at random (always
    the same ones); the cheapest plan counts.
    """
    k = len(quota)
    whole = np.floor(flow / each[:, None] + 1e-9).astype(int)
    load = (whole * each[:, None]).sum(0)
    for b in np.argsort(-each, kind="stable").tolist():
        for _ in range(int(count[b] - whole[b].sum())):
            s = int(np.argmin([each[b] * cost[b, s] + over * np.abs(load + each[b] * (np.arange(k) == s) - quota).sum() for s in range(k)]))
            whole[b, s] += 1
            load[s] += each[b]
    value, rnd = _descend(whole, each, quota, cost, over), np.random.default_rng(0)
    for _ in range(kicks):
        other = whole.copy()
        for _ in range(3):
            # Large components decide what can be met, so they are moved most.
            b = int(rnd.choice(len(each), p=each / each.sum()))
            s, t = int(rnd.choice(np.flatnonzero(other[b] > 0))), int(rnd.integers(k))
            other[b, s] -= 1
            other[b, t] += 1
        if (v := _descend(other, each, quota, cost, over)) < value - 1e-9:
            value, whole = v, other
    return whole


def assign_splits(rows: DataFrame, shares: dict[str, float], over: float = 4.0, seed: str = "split") -> DataFrame:
    """``rows`` (see plan_rows) with ``component`` and ``split``; shares are the wanted parts of all rows.

    Components never part, so a share can be missed by as much as the largest
    component allows. Same rows, same result, whatever the partitioning.
    """
    spark = rows.sparkSession
    parts = list(shares)
    placed = written(row_components(rows))
    counts = [F.count_if(F.col("part") == p).alias(f"n_{p}") for p in parts]
    comp = placed.groupBy("component").agg(F.count(F.lit(1)).alias("n"), *counts)
    size_key = F.when(F.col("n") <= EXACT_SIZE, F.col("n")).otherwise(EXACT_SIZE + F.floor(F.log2(F.col("n") / EXACT_SIZE) * 16) + 1).cast("long")
    shape = [F.floor(F.col(f"n_{p}") * 8 / F.col("n")).cast("int") for p in parts]
    comp = comp.withColumn("bundle", F.concat_ws(":", size_key.cast("string"), *[x.cast("string") for x in shape]))
    hashed = comp.withColumn("__h", F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "component")), 1, 12), 16, 10).cast("long"))
    hashed = hashed.withColumn("__chunk", F.shiftright("__h", 36))
    bundles = comp.groupBy("bundle").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), *[F.sum(f"n_{p}").alias(f"n_{p}") for p in parts]).orderBy("bundle").collect()
    if not bundles:
        return placed.withColumn("split", F.lit(None).cast("string"))
    n, k = np.array([r["n"] for r in bundles], float), np.array([r["k"] for r in bundles])
    cost = 1 - np.array([[r[f"n_{p}"] for p in parts] for r in bundles], float) / n[:, None]
    quota = np.array([shares[p] for p in parts]) / sum(shares.values()) * n.sum()
    whole = round_components(min_cost_quotas(n, cost, quota, over), n / k, k, quota, cost, over)
    upto = np.cumsum(whole, axis=1)
    plan = spark.createDataFrame([(r["bundle"], [int(x) for x in u]) for r, u in zip(bundles, upto)], "bundle string, upto array<bigint>")
    ranked = running_sum(hashed, ["bundle"], "__chunk", [F.col("__h"), F.col("component")], F.lit(1), "__rank")
    pick = F.element_at(F.array(*[F.lit(p) for p in parts]), (F.size(F.filter("upto", lambda x: x < F.col("__rank"))) + 1).cast("int"))
    # The plan has one row per bundle, the bundles of the driver's table.
    chosen = ranked.join(F.broadcast(plan), "bundle").select("component", pick.alias("split"))
    return salted_join(placed, chosen, "component", hot_keys(placed, "component", placed.count()), ["chunk_id"])


def parted_groups(assigned: DataFrame) -> DataFrame:
    """Meetings and persons whose given parts differ, with what ``assign_splits`` makes of them: group_kind, group_id,
    n_rows, n_train, n_dev, n_test, n_parts, n_splits (1, as no group is parted any more).

    A group lies in one component, so only the rows of components whose label
    profile has more than one part are looked at.
    """
    mixed = assigned.groupBy("component").agg(sum(((F.count_if(F.col("part") == p) > 0).cast("int") for p in PARTS), F.lit(0)).alias("__n")).filter("__n > 1").select("component")
    some = salted_join(assigned, mixed, "component", hot_keys(assigned, "component", assigned.count()), ["chunk_id"], "left_semi")
    return label_profiles(some, F.countDistinct("split").alias("n_splits")).filter("n_parts > 1")
