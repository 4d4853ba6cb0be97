"""Global ranking from pairwise comparisons.

Strengths maximise a penalised likelihood of comparisons with draws and an advantage for the item shown first
(Davidson and Beaver's form): with strengths x and y, first-position term d and draw term n the weights of
"first wins", "second wins" and "draw" are exp(x + d), exp(y) and exp(n + (x + d + y) / 2). The function is
concave, so the Newton steps below end at its one maximum. Both terms are always fitted, under the same penalty:
where no first item is known its term stays 0, and where no draw occurs the draw term falls as far as the penalty lets it.

Comparisons are first aggregated to one row per context and pair. A context with at most ``LOCAL_PAIRS`` such
rows is solved in one task; a larger one by the same Newton steps over DataFrames, so no context is too large.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.operators.skew import dense_rank_blocks
from framelake.session import cut_lineage

LOCAL_PAIRS = 2_000_000
PENALTY = 0.1
#: A solver ends when no unknown moves this far in a Newton step, and raises if that doesn't happen.
SETTLED = 1e-7


def pair_counts(votes: DataFrame) -> DataFrame:
    """One row (``context``, ``a`` < ``b``, ``known``, ``first_a``, ``wa``, ``wb``, ``wd``, ``n``) per context, pair and order.

    ``votes`` has ``context``, ``winner``, ``loser``, ``weight`` and optionally ``draw`` (boolean) and ``first``
    (the item shown first, may be null). Rows with a null context or item, an item against itself, or a weight
    that is null, not finite or not above zero do not count.
    """
    draw = F.coalesce(F.col("draw"), F.lit(False)) if "draw" in votes.columns else F.lit(False)
    first = F.col("first") if "first" in votes.columns else F.lit(None).cast("string")
    good = votes.where("context is not null and winner is not null and loser is not null and winner <> loser and weight > 0").where(~F.isnan("weight") & (F.col("weight") < float("inf")))
    rows = good.select(
        "context",
        F.least("winner", "loser").alias("a"),
        F.greatest("winner", "loser").alias("b"),
        (F.col("winner") < F.col("loser")).alias("up"),
        draw.alias("d"),
        first.alias("f"),
        F.col("weight").cast("double").alias("w"),
    )
    rows = rows.withColumn("known", F.coalesce((F.col("f") == F.col("a")) | (F.col("f") == F.col("b")), F.lit(False)))
    rows = rows.withColumn("first_a", F.col("known") & F.coalesce(F.col("f") == F.col("a"), F.lit(False)))
    zero = F.lit(0.0)
    return rows.groupBy("context", "a", "b", "known", "first_a").agg(
        F.sum(F.when(~F.col("d") & F.col("up"), F.col("w")).otherwise(zero)).alias("wa"),
        F.sum(F.when(~F.col("d") & ~F.col("up"), F.col("w")).otherwise(zero)).alias("wb"),
        F.sum(F.when(F.col("d"), F.col("w")).otherwise(zero)).alias("wd"),
        F.count(F.lit(1)).alias("n"),
    )


def solve_context(a: np.ndarray, b: np.ndarray, order: np.ndarray, wa: np.ndarray, wb: np.ndarray, wd: np.ndarray, items: int, penalty: float) -> tuple[np.ndarray, float, float, np.ndarray]:
    """Strengths, first-position term, draw term and curvatures; ``order`` is +1, -1 or 0 for a first, b first, unknown."""
    total = wa + wb + wd
    def spread(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        half = (x[a] - x[b]) / 2 + order * x[-2] / 2
        return half, -half, np.full(len(a), x[-1])

    def gather(g1: np.ndarray, g2: np.ndarray, g3: np.ndarray) -> np.ndarray:
        half = (g1 - g2) / 2
        out = np.bincount(a, half, items + 2) - np.bincount(b, half, items + 2)
        out[-2], out[-1] = (order * half).sum(), g3.sum()
        return out

    def chances(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        u1, u2, u3 = spread(x)
        top = np.maximum(np.abs(u1), u3)
        e1, e2, e3 = np.exp(u1 - top), np.exp(u2 - top), np.exp(u3 - top)
        z = e1 + e2 + e3
        return e1 / z, e2 / z, e3 / z, wa * u1 + wb * u2 + wd * u3 - total * (top + np.log(z))

    x = np.zeros(items + 2)
    p1, p2, p3, like = chances(x)
    best = like.sum()
    for _ in range(60):
        grad = gather(wa - total * p1, wb - total * p2, wd - total * p3) - penalty * x

        def curve(s: np.ndarray) -> np.ndarray:
            d1, d2, d3 = spread(s)
            mean = p1 * d1 + p2 * d2 + p3 * d3
            return gather(total * p1 * (d1 - mean), total * p2 * (d2 - mean), total * p3 * (d3 - mean)) + penalty * s

        bend = total * ((p1 + p2) / 4 - ((p1 - p2) / 2) ** 2)
        diagonal = np.bincount(a, bend, items + 2) + np.bincount(b, bend, items + 2) + penalty
        diagonal[-2] += (order**2 * bend).sum()
        diagonal[-1] += (total * p3 * (1 - p3)).sum()
        step, left = np.zeros_like(x), grad.copy()
        z = left / diagonal
        way, was = z.copy(), left @ z
        for _ in range(200):
            if was <= 1e-20:
                break
            bent = curve(way)
            pace = was / (way @ bent)
            step += pace * way
            left -= pace * bent
            z = left / diagonal
            now = left @ z
            if now < 1e-16 * max(1.0, grad @ (grad / diagonal)):
                break
            way = z + now / was * way
            was = now
        size = 1.0
        while size > 1e-6:
            p1, p2, p3, like = chances(x + size * step)
            value = like.sum() - penalty / 2 * ((x + size * step) ** 2).sum()
            if value >= best - 1e-12 * abs(best):
                break
            size /= 2
        x, best = x + size * step, value
        if np.abs(size * step).max() < SETTLED:
            break
    else:
        raise RuntimeError(f"{items} items not settled")
    return x[:items], float(x[-2]), float(x[-1]), diagonal[:items]


def _solve(penalty: float):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        names, codes = np.unique(np.concatenate([rows["a"].to_numpy(str), rows["b"].to_numpy(str)]), return_inverse=True)
        a, b = codes[: len(rows)], codes[len(rows) :]
        order = np.where(rows["known"], np.where(rows["first_a"], 1.0, -1.0), 0.0)
        strength, first, draw, bend = solve_context(a, b, order, *(rows[c].to_numpy(float) for c in ("wa", "wb", "wd")), len(names), penalty)
        votes = np.bincount(a, rows["n"], len(names)) + np.bincount(b, rows["n"], len(names))
        return pd.DataFrame({"context": key[0], "item": names, "strength": strength, "stderr": 1 / np.sqrt(bend), "votes": votes.astype("int64"), "first_term": first, "draw_term": draw})

    return run


ITEMS = "context string, item string, strength double, stderr double, votes long, first_term double, draw_term double"


#: Names of the two extra unknowns of a context, kept beside its items; no item key starts with this mark.
_FIRST, _DRAW = "\x01first", "\x01draw"


def _solve_spread(pairs: DataFrame, penalty: float, steps: int = 60, inner: int = 200) -> DataFrame:
    """The same maximum for contexts of any size: Newton steps by preconditioned conjugate gradients over DataFrames.

    The unknowns are rows; the first-position and draw terms are two more rows of each context. A product with
    the curvature is one pass over the pairs, whose sums combine before the shuffle. The two terms and the numbers of
    a conjugate step, one row a context, are broadcast: only contexts beyond the local bound come here, so there are
    no more than a fraction of the pairs over that bound. It ends as the local solver does, or raises.
    """
    order = F.when(~F.col("known"), F.lit(0.0)).when(F.col("first_a"), F.lit(1.0)).otherwise(F.lit(-1.0))
    pairs = cut_lineage(pairs.select("context", "a", "b", order.alias("o"), "wa", "wb", "wd", (F.col("wa") + F.col("wb") + F.col("wd")).alias("t"), "n"), forget=True)
    ends = pairs.select("context", F.explode(F.array("a", "b")).alias("item"), "n")
    contexts = pairs.select("context").distinct()
    extra = contexts.select("context", F.explode(F.array(F.lit(_FIRST), F.lit(_DRAW))).alias("item"), F.lit(0).cast("long").alias("votes"))
    items = cut_lineage(ends.groupBy("context", "item").agg(F.sum("n").alias("votes")).unionByName(extra).withColumn("x", F.lit(0.0)), forget=True)

    def meet(rows: DataFrame, value: DataFrame, name: str) -> DataFrame:
        def part(item: str, to: str) -> DataFrame:
            return F.broadcast(value.where(F.col("item") == item).select("context", F.col(name).alias(to)))

        left, right = value.select("context", F.col("item").alias("a"), F.col(name).alias("va")), value.select("context", F.col("item").alias("b"), F.col(name).alias("vb"))
        return rows.join(left, ["context", "a"]).join(right, ["context", "b"]).join(part(_FIRST, "vo"), "context").join(part(_DRAW, "vd"), "context")

    def scatter(rows: DataFrame, half: Column, third: Column, bend: Column, bend3: Column) -> DataFrame:
        def to(item: Column, v: Column, c: Column) -> Column:
            return F.struct(item.alias("item"), v.alias("v"), c.alias("c"))

        o = F.col("o")
        parts = F.array(to(F.col("a"), half, bend), to(F.col("b"), -half, bend), to(F.lit(_FIRST), o * half, o * o * bend), to(F.lit(_DRAW), third, bend3))
        return rows.select("context", F.explode(parts).alias("q")).select("context", "q.*").groupBy("context", "item").agg(F.sum("v").alias("v"), F.sum("c").alias("c"))

    half = (F.col("va") - F.col("vb") + F.col("o") * F.col("vo")) / 2
    e3 = F.exp("vd")
    norm = F.exp(half) + F.exp(-half) + e3
    t, p1, p2, p3 = F.col("t"), F.col("p1"), F.col("p2"), F.col("p3")
    for _ in range(steps):
        at = meet(pairs, items, "x")
        at = at.select("context", "a", "b", "o", "wa", "wb", "wd", "t", (F.exp(half) / norm).alias("p1"), (F.exp(-half) / norm).alias("p2"), (e3 / norm).alias("p3"))
        at = cut_lineage(at, forget=True)
        grad = scatter(at, ((F.col("wa") - t * p1) - (F.col("wb") - t * p2)) / 2, F.col("wd") - t * p3, t * ((p1 + p2) / 4 - F.pow((p1 - p2) / 2, 2)), t * p3 * (1 - p3))
        state = items.join(grad, ["context", "item"]).select("context", "item", "votes", "x", (F.col("v") - penalty * F.col("x")).alias("r"), (F.col("c") + penalty).alias("g"))
        state = cut_lineage(state.select("*", F.lit(0.0).alias("s"), (F.col("r") / F.col("g")).alias("p")), forget=True)
        start = None
        for _ in range(inner):
            d1 = (F.col("va") - F.col("vb") + F.col("o") * F.col("vo")) / 2
            d3 = F.col("vd")
            mean = (p1 - p2) * d1 + p3 * d3
            bent = scatter(meet(at, state, "p"), (t * p1 * (d1 - mean) - t * p2 * (-d1 - mean)) / 2, t * p3 * (d3 - mean), F.lit(0.0), F.lit(0.0)).drop("c")
            mid = cut_lineage(state.join(bent, ["context", "item"]).withColumn("q", F.col("v") + penalty * F.col("p")).drop("v"), forget=True)
            r, q, g = F.col("r"), F.col("q"), F.col("g")
            # with z = r / g both the step and the turn follow from these sums of one pass
            sums = mid.groupBy("context").agg(F.sum(r * r / g).alias("rz"), F.sum(F.col("p") * q).alias("pq"), F.sum(r * q / g).alias("rq"), F.sum(q * q / g).alias("qq"))
            k = F.when(F.col("pq") > 0, F.col("rz") / F.col("pq")).otherwise(F.lit(0.0))
            sums = sums.withColumn("k", k).withColumn("new", F.greatest(F.lit(0.0), F.col("rz") - 2 * F.col("k") * F.col("rq") + F.col("k") * F.col("k") * F.col("qq")))
            sums = cut_lineage(sums, forget=True)
            start = sums.select("context", F.col("rz").alias("rz0")) if start is None else start
            turn = F.when(F.col("rz") > 0, F.col("new") / F.col("rz")).otherwise(F.lit(0.0))
            rest = r - F.col("k") * q
            state = mid.join(F.broadcast(sums), "context").select("context", "item", "votes", "x", "g", (F.col("s") + F.col("k") * F.col("p")).alias("s"), rest.alias("r"), (rest / g + turn * F.col("p")).alias("p"))
            # a Newton step needs its direction only as well as this; the worst context counts
            left = sums.join(F.broadcast(start), "context").agg(F.max(F.when(F.col("rz0") > 0, F.col("new") / F.col("rz0")).otherwise(F.lit(0.0)))).head()[0]
            if not left or left < 1e-6:
                break
        else:
            raise RuntimeError("a Newton step is not settled")
        state = cut_lineage(state, forget=True)
        moved = state.agg(F.max(F.abs("s"))).head()[0] or 0.0
        damp = min(1.0, 2.0 / moved) if moved else 1.0
        items = cut_lineage(state.select("context", "item", "votes", (F.col("x") + damp * F.col("s")).alias("x"), "g"), forget=True)
        if moved < SETTLED:
            break
    else:
        raise RuntimeError("strengths are not settled")
    terms = [items.where(F.col("item") == n).select("context", F.col("x").alias(to)) for n, to in ((_FIRST, "first_term"), (_DRAW, "draw_term"))]
    found = items.where((F.col("item") != _FIRST) & (F.col("item") != _DRAW)).join(terms[0], "context").join(terms[1], "context")
    return found.select("context", "item", F.col("x").alias("strength"), (1 / F.sqrt("g")).alias("stderr"), "votes", "first_term", "draw_term")


def rank_items(pairs: DataFrame, penalty: float = PENALTY, local_pairs: int = LOCAL_PAIRS) -> DataFrame:
    """Rows (``context``, ``item``, ``strength``, ``stderr``, ``votes``, ``first_term``, ``draw_term``, ``rank``, ``ranked``).

    ``pairs`` comes from ``pair_counts``. The best item has rank 1; equal strengths are ordered by item. The
    penalty (a normal prior on the strengths) keeps items with few or one-sided votes finite and parts that no
    vote connects comparable. Empty input gives no rows.
    """
    sizes = pairs.groupBy("context").agg(F.count(F.lit(1)).alias("_size"))
    large = sizes.where(F.col("_size") > local_pairs).select("context")
    found = pairs.join(sizes.where(F.col("_size") <= local_pairs).select("context"), "context", "left_semi").groupBy("context").applyInPandas(_solve(penalty), ITEMS)
    if not large.isEmpty():
        found = found.unionByName(_solve_spread(pairs.join(large, "context", "left_semi"), penalty))
    found = cut_lineage(found)
    ranked = dense_rank_blocks(found, ["context"], F.floor(-F.round("strength", 9) * 16), [F.desc(F.round("strength", 9)), F.col("item")], "rank")
    count = found.groupBy("context").agg(F.count(F.lit(1)).alias("ranked"))
    return ranked.join(count, "context")


def upsets(pairs: DataFrame, ranking: DataFrame, min_votes: int, min_share: float) -> DataFrame:
    """Rows (``context``, ``a``, ``b``): direct votes favour one item, the ranking the other by ``min_share`` of the items.

    Both items need ``min_votes`` votes; direct votes are compared by total weight, a tie favours none.
    """
    direct = pairs.groupBy("context", "a", "b").agg(F.sum("wa").alias("wa"), F.sum("wb").alias("wb")).where("wa <> wb")
    known = ranking.where(F.col("votes") >= min_votes).select("context", "item", "rank", "ranked")
    left = known.select("context", F.col("item").alias("a"), F.col("rank").alias("ra"), "ranked")
    right = known.select("context", F.col("item").alias("b"), F.col("rank").alias("rb"))
    met = direct.join(left, ["context", "a"]).join(right, ["context", "b"])
    lead = F.when(F.col("wa") > F.col("wb"), F.col("ra") - F.col("rb")).otherwise(F.col("rb") - F.col("ra"))
    return met.where(lead >= F.col("ranked") * min_share).select("context", "a", "b")
