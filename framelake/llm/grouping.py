"""Splits that keep related records together.

Records that share a key, or whose keys share a source, form components. Components are bundled by size and
label profile; a min-cost flow with deviation costs allots each kind of bundle to the splits, is rounded to
whole components, and the members of a bundle are dealt out in hash order.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.components import components
from framelake.operators.skew import dense_rank_blocks, lookup_join
from framelake.session import cut_lineage

EXACT_SIZES = 1024
PROFILE_STEPS = 8


def record_groups(records: DataFrame, id_col: str, keys: list[str], key_sources: DataFrame | None = None) -> DataFrame:
    """Rows (``id_col``, ``group_id``, ``group_size``): the least id of all records a record must stay with.

    Records stay together if they share a non-null key, or hold keys that ``key_sources`` (``key``, ``source``)
    gives the same non-null source, directly or through others. Records without any key take no part; ids are
    unique longs. Nodes of the graph are least record ids per key, so no hashes can collide; a key or source
    that holds most records is spread by ``lookup_join``.
    """
    mentions = records.select(F.col(id_col).alias("id"), F.explode(F.array(*keys)).alias("key")).where("key is not null and id is not null")
    per_key = cut_lineage(mentions.groupBy("key").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n")))
    owned = lookup_join(mentions, per_key, "key", "n")
    spans = cut_lineage(owned.groupBy("id").agg(F.min("node").alias("node"), F.max("node").alias("far")))
    links = spans.where("node <> far").select(F.col("node").alias("a"), F.col("far").alias("b"))
    if key_sources is not None:
        placed = key_sources.where("key is not null and source is not null").select("key", "source").distinct().join(per_key.select("key", "node"), "key").select("source", "node").distinct()
        per_source = placed.groupBy("source").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
        links = links.unionByName(lookup_join(placed, per_source, "source", "n").select(F.col("node").alias("a"), F.col("least").alias("b")))
    roots = components(links)
    nodes = spans.groupBy("node").agg(F.count(F.lit(1)).alias("n")).join(roots, "node", "left").select("node", "n", F.coalesce("root", "node").alias("root"))
    sizes = nodes.groupBy("root").agg(F.sum("n").alias("group_size"), F.count(F.lit(1)).alias("nodes"))
    nodes = lookup_join(nodes, sizes, "root", "nodes")
    return lookup_join(spans.select("id", "node"), nodes, "node", "n").select(F.col("id").alias(id_col), F.col("root").alias("group_id"), "group_size")


def min_cost_flow(n: int, arcs: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Flow on each arc (from, to, capacity, cost) of a cheapest maximum flow, by successive shortest paths."""
    graph: list[list[int]] = [[] for _ in range(n)]
    to, left, price = [], [], []
    for a, b, cap, cost in arcs:
        graph[a].append(len(to))
        to.append(b), left.append(cap), price.append(cost)
        graph[b].append(len(to))
        to.append(a), left.append(0), price.append(-cost)
    while True:
        far, via, queue, queued = [math.inf] * n, [-1] * n, [source], [False] * n
        far[source] = 0
        while queue:
            u = queue.pop(0)
            queued[u] = False
            for e in graph[u]:
                if left[e] and far[u] + price[e] < far[to[e]]:
                    far[to[e]], via[to[e]] = far[u] + price[e], e
                    if not queued[to[e]]:
                        queued[to[e]] = True
                        queue.append(to[e])
        if far[sink] == math.inf:
            return [left[2 * i + 1] for i in range(len(arcs))]
        path, v = [], sink
        while v != source:
            path.append(via[v])
            v = to[via[v] ^ 1]
        push = min(left[e] for e in path)
        for e in path:
            left[e] -= push
            left[e ^ 1] += push


def allot(bundles: list[dict], shares: dict[str, float]) -> dict[tuple, dict[str, int]]:
    """Whole components of each bundle (``key``, ``profile``, ``components``, ``records``) per split.

    Bundles of one profile that fit the same splits are one node of the flow. A split takes its quota at no
    cost, more at a high one; a profile's share of a split likewise at a low one. Largest components are
    rounded first, each to the split that lacks most, so the error is below one component of the last size.
    """
    names, total = list(shares), sum(b["records"] for b in bundles)
    quota = {s: round(shares[s] * total) for s in names}
    nodes: dict[tuple, int] = {}
    for b in bundles:
        mean = b["records"] / b["components"]
        fits = tuple(s for s in names if mean <= quota[s]) or (max(names, key=quota.get),)
        b["node"] = (b["profile"], fits)
        nodes[b["node"]] = nodes.get(b["node"], 0) + b["records"]
    profiles = sorted({p for p, _ in nodes})
    number = {x: i + 2 for i, x in enumerate([*nodes, *[(p, s) for p in profiles for s in names], *names])}
    arcs = [(0, number[k], v, 0) for k, v in nodes.items()]
    for k in nodes:
        arcs += [(number[k], number[(k[0], s)], nodes[k], 0) for s in k[1]]
    middle = len(arcs)
    for p in profiles:
        own = sum(v for k, v in nodes.items() if k[0] == p)
        for s in names:
            arcs += [(number[(p, s)], number[s], round(shares[s] * own), 0), (number[(p, s)], number[s], own, 1)]
    for s in names:
        arcs += [(number[s], 1, quota[s], 0), (number[s], 1, total, 100)]
    flow = min_cost_flow(len(number) + 2, arcs, 0, 1)
    want = {}
    for (a, b, _, _), f in zip(arcs[:middle], flow):
        if a:
            want[(a, b)] = f
    given: dict[tuple, dict[str, int]] = {}
    for b in sorted(bundles, key=lambda x: -x["records"] / x["components"]):
        mean, rest = b["records"] / b["components"], b["components"]
        need = {s: want[(number[b["node"]], number[(b["profile"], s)])] for s in b["node"][1]}
        share = sum(need.values()) or 1
        got = {s: min(rest, math.floor(b["records"] * need[s] / share / mean)) for s in need}
        while sum(got.values()) < rest:
            s = max(need, key=lambda x: need[x] - got[x] * mean)
            got[s] += 1
        for s, c in got.items():
            want[(number[b["node"]], number[(b["profile"], s)])] -= round(c * mean)
        given[b["key"]] = got
    return given


def assign_splits(groups: DataFrame, shares: dict[str, float], label: str, seed: int = 0) -> DataFrame:
    """Add ``split`` to every record of ``groups`` (``group_id``, ``label``, other columns); groups never part.

    Bundles are exact in size up to ``EXACT_SIZES`` records and 1 % wide above; the profile is the share of the
    most frequent label value's complement in eighths. So the driver sees at most a few ten thousand bundles,
    whatever the number of groups. Null labels count as a value of their own; an empty table stays empty.
    """
    value = F.coalesce(F.col(label).cast("string"), F.lit(""))
    common = groups.groupBy(value.alias("v")).count().orderBy(F.desc("count"), "v").limit(1).select(F.col("v").alias("_common"))
    flagged = groups.join(F.broadcast(common)).withColumn("_is", (value == F.col("_common")).cast("long"))
    parts = flagged.groupBy("group_id").agg(F.count(F.lit(1)).alias("size"), F.sum("_is").alias("_k"))
    width = F.when(F.col("size") <= EXACT_SIZES, F.col("size")).otherwise(EXACT_SIZES + F.ceil(F.log(F.col("size") / EXACT_SIZES) / math.log(1.01)))
    parts = cut_lineage(parts.select("group_id", "size", width.cast("long").alias("width"), F.round(F.col("_k") * PROFILE_STEPS / F.col("size")).cast("long").alias("profile")))
    rows = parts.groupBy("width", "profile").agg(F.count(F.lit(1)).alias("components"), F.sum("size").alias("records")).collect()
    bundles = [{"key": (r["width"], r["profile"]), "profile": r["profile"], "components": r["components"], "records": r["records"]} for r in rows]
    given, names, cuts = allot(bundles, shares), list(shares), []
    for (width, profile), got in given.items():
        upto = 0
        for s in names:
            if got.get(s):
                cuts.append((width, profile, upto, upto + got[s], s))
                upto += got[s]
    spark = groups.sparkSession
    table = spark.createDataFrame(cuts, "width long, profile long, lo long, hi long, split string")
    mixed = F.xxhash64("group_id", F.lit(seed))
    placed = dense_rank_blocks(parts.withColumn("_h", mixed), ["width", "profile"], F.shiftright("_h", 52), [F.col("_h"), F.col("group_id")], "_at")
    chosen = placed.join(F.broadcast(table), (placed["width"] == table["width"]) & (placed["profile"] == table["profile"]) & (F.col("_at") > F.col("lo")) & (F.col("_at") <= F.col("hi")))
    return lookup_join(groups, chosen.select("group_id", F.col("split"), F.col("size").alias("_s")), "group_id", "_s")
