"""Most similar vectors for every vector, by cross-polytope hashing with multiprobe tables.

Unit vectors pass fast pseudo-rotations (three rounds of random signs and a Hadamard transform) and fall to the
nearest signed axis; two such hashes give a bucket of one table. Every vector is stored once per table, and
asks its own bucket and the next best ones. Vectors of one byte a component only leave out entries that meet
nothing near the threshold; inside a bucket the others are compared and ranked by exact cosines.

Without a threshold the number of buckets follows the number of rows, and tables and probes are the least that meet
a stated share of the true neighbours of a bounded sample. A row then goes to a task once with all its buckets there.

Two kinds of groups stay bounded. Copies of one vector are collapsed: only the ``k + 1`` least ids of a
group of copies can be among anybody's ``k`` most similar (ties go to the lesser id), so the others only take
over the list of their group. A bucket with more than ``BUCKET_ROWS`` entries is searched completely, in a grid of
blocks: nothing is lost in a dense group, whose members differ only by noise that no hash can order, at a cost
that is quadratic in that group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.operators.skew import lookup_join
from framelake.session import cut_lineage

TABLES = 8
PROBES = 3
HASHES = 2
BUCKET_ROWS = 8192
SLACK = 0.03
COMPLETE_BLOCK, COMPLETE_CELLS = 32768, 4


def usable(vector: Column, size: int) -> Column:
    """Whether a vector has ``size`` components, all finite and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == size) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _hadamard(x: np.ndarray) -> np.ndarray:
    n, step = x.shape[1], 1
    while step < n:
        y = x.reshape(len(x), -1, 2, step)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(len(x), n)
        step *= 2
    return x / np.sqrt(n)


def rotations(size: int, count: int, seed: int) -> np.ndarray:
    """Random signs of ``count`` pseudo-rotations in the next power of two dimensions."""
    width = 1 << max(1, (size - 1).bit_length())
    return np.random.default_rng(seed).choice([-1.0, 1.0], size=(count, 3, width)).astype(np.float32)


def buckets(x: np.ndarray, signs: np.ndarray, hashes: int, probes: int) -> np.ndarray:
    """Bucket numbers (rows, tables, 1 + probes): the own bucket first, then the likeliest others.

    A probe replaces one axis by another; it is the likelier the less the projection falls short of the best.
    """
    width = signs.shape[2]
    x = np.pad(x, ((0, 0), (0, width - x.shape[1]))).astype(np.float32)
    out = np.zeros((len(x), len(signs) // hashes, 1 + probes), np.int64)
    rows = np.arange(len(x))
    for t in range(len(signs) // hashes):
        axes, lost = [], []
        for h in range(hashes):
            y = x
            for s in signs[t * hashes + h]:
                y = _hadamard(y * s)
            signed = np.concatenate([y, -y], axis=1)
            near = np.argpartition(-signed, probes, axis=1)[:, : probes + 1]
            value = np.take_along_axis(signed, near, 1)
            order = np.argsort(-value, axis=1, kind="stable")
            near, value = np.take_along_axis(near, order, 1), np.take_along_axis(value, order, 1)
            axes.append(near)
            lost.append((value[:, :1] - value[:, 1:]) ** 2)
        own = np.zeros(len(x), np.int64)
        for h in range(hashes):
            own = own * (2 * width) + axes[h][:, 0]
        out[:, t, 0] = own
        best = np.argsort(np.concatenate(lost, axis=1), axis=1, kind="stable")[:, :probes]
        for p in range(probes):
            h, j = best[:, p] // probes, best[:, p] % probes + 1
            other = np.zeros(len(x), np.int64)
            for g in range(hashes):
                other = other * (2 * width) + np.where(h == g, axes[g][rows, np.where(h == g, j, 0)], axes[g][:, 0])
            out[:, t, 1 + p] = other
    return out


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float32) for v in column.to_numpy()]) if len(column) else np.zeros((0, 1), np.float32)


def _scaled(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _bytes(units: np.ndarray) -> list[bytes]:
    return [r.tobytes() for r in np.rint(units * 127 / np.maximum(np.abs(units).max(1, keepdims=True), 1e-12)).astype(np.int8)]


def _units(packed: pd.Series) -> np.ndarray:
    x = np.frombuffer(b"".join(packed), np.int8).reshape(len(packed), -1).astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _hash(size: int, tables: int, hashes: int, probes: int, seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signs = rotations(size, tables * hashes, seed)
        for b in batches:
            x = _matrix(b["vector"])
            if not len(x):
                continue
            x = _scaled(x)
            keys = buckets(x, signs, hashes, probes)
            each = keys.shape[1] * keys.shape[2]
            number = np.tile(np.repeat(np.arange(keys.shape[1]), keys.shape[2]), len(x))
            stored = np.tile(np.arange(keys.shape[2]) == 0, len(x) * keys.shape[1])
            packed = np.repeat(np.array(_bytes(x), object), each)
            yield pd.DataFrame({"id": np.repeat(b["id"].to_numpy(), each), "bucket": keys.reshape(-1) * tables + number, "stored": stored, "q": packed})

    return run


#: Candidates, and rows that go on to the exact search.
CANDIDATES, ALIVE = "a long, b long, cosine double", "bucket long, id long, stored boolean"
CELLS = 1 << 24
#: More than the greatest error of a scalar product of unit vectors of 64 single-precision components, for each component.
ROUNDING = 1.2e-7


def _floor(s: np.ndarray, k: int) -> np.ndarray:
    """Of every row a bound that at least ``k`` entries reach: the ``k``-th best of the maxima of slices."""
    if s.shape[1] <= k:
        return np.full(len(s), -1.5)
    width = s.shape[1] // max(256, 4 * k)
    if width > 1:
        slices = s.shape[1] // width
        s = s[:, : slices * width].reshape(len(s), width, slices).max(1)
    return np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]


def _best(ids: np.ndarray, x: np.ndarray, kept: np.ndarray, others: np.ndarray, k: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of every row exactly the ``k`` best stored rows with a cosine of ``least`` or more, ties to the lesser id.

    Single precision only leaves out what its rounding can't bring among the ``k``; the rest is compared in doubles.
    """
    order = np.argsort(others, kind="stable")
    kept, others = kept[order], others[order]
    single, margin, step = kept.astype(np.float32), ROUNDING * (x.shape[1] + 2), max(1, CELLS // len(kept))
    for i in range(0, len(ids), step):
        own, rows = ids[i : i + step], x[i : i + step]
        s = rows.astype(np.float32) @ single.T
        place = np.minimum(np.searchsorted(others, own), len(others) - 1)
        same = np.nonzero(others[place] == own)[0]
        s[same, place[same]] = -2
        near = s >= np.maximum(_floor(s, k) - 2 * margin, max(least - margin, -1.5))[:, None]
        count = near.sum(1)
        # few: only those; many, as in a group of near copies: the whole row in doubles
        many = np.nonzero(count > 64 * k)[0]
        near[many] = False
        r, c = np.nonzero(near)
        value = np.einsum("ij,ij->i", rows[r], kept[c])
        for j in range(0, len(many), max(1, step // 4)):
            at = many[j : j + max(1, step // 4)]
            t = rows[at] @ kept.T
            t[others[None, :] == own[at, None]] = -2
            t = t.round(12)
            bound = np.partition(t, t.shape[1] - k, axis=1)[:, t.shape[1] - k][:, None]
            above, tie = t > bound, t == bound
            pick = above | (tie & (np.cumsum(tie, axis=1, dtype=np.int32) <= k - above.sum(1)[:, None]))
            q, d = np.nonzero(pick)
            r, c, value = np.append(r, at[q]), np.append(c, d), np.append(value, np.einsum("ij,ij->i", rows[at[q]], kept[d]))
        r, c, value = (v[value >= least] for v in (r, c, value))
        sort = np.lexsort((c, -value.round(12), r))
        r, c, value = r[sort], c[sort], value[sort]
        first = np.arange(len(r)) - np.searchsorted(r, r) < k
        yield own[r[first]], others[c[first]], value[first]


def _meeting(rows: pd.DataFrame, bounds: list[tuple[int, int]], least: float) -> pd.DataFrame:
    """Rows that meet anything at a rough cosine of ``least`` or more, as the asking or the stored side."""
    ids, stored, x = rows["id"].to_numpy(), rows["stored"].to_numpy(), _units(rows["q"])
    alive = np.zeros(len(rows), bool)
    for i, j in bounds:
        kept = i + np.nonzero(stored[i:j])[0]
        if j - i < 2 or not len(kept):
            continue
        for r in range(i, j, 2048):
            hit = x[r : min(j, r + 2048)] @ x[kept].T >= least
            hit &= ids[r : min(j, r + 2048), None] != ids[None, kept]
            alive[r : min(j, r + 2048)] |= hit.any(1)
            alive[kept] |= hit.any(0)
    return rows.loc[alive, ["bucket", "id", "stored"]]


def _candidates(rows: pd.DataFrame, bounds: list[tuple[int, int]], k: int, least: float) -> pd.DataFrame:
    ids, stored = rows["id"].to_numpy(), rows["stored"].to_numpy()
    x = _scaled(_matrix(rows["vector"]).astype(np.float64))
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for i, j in bounds:
        m = stored[i:j]
        if j - i > 1 and m.any():
            found += _best(ids[i:j], x[i:j], x[i:j][m], ids[i:j][m], k, least)
    return pd.DataFrame(dict(zip(("a", "b", "cosine"), (np.concatenate(v) for v in zip(*found)))))


def _collect(group: list[str], work):
    """``work`` on the runs of equal ``group`` values of sorted partitions; a run is kept until it ends."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []

        def closed(b: pd.DataFrame) -> pd.DataFrame:
            key = b[group].to_numpy()
            starts = np.concatenate([[0], np.nonzero((key[1:] != key[:-1]).any(1))[0] + 1, [len(b)]])
            return work(b, list(zip(starts[:-1], starts[1:])))

        for b in batches:
            if not len(b):
                continue
            key = b[group].to_numpy()
            cut = np.nonzero((key[1:] != key[:-1]).any(1))[0]
            if rest and (rest[-1][group].to_numpy()[-1] != key[0]).any():
                yield closed(pd.concat(rest, ignore_index=True))
                rest = []
            if not len(cut):
                rest.append(b)
                continue
            at = cut[-1] + 1
            done = pd.concat([*rest, b[:at]], ignore_index=True)
            rest = [b[at:]]
            yield closed(done)
        if rest:
            yield closed(pd.concat(rest, ignore_index=True))

    return run


def _runs(rows: DataFrame, group: list[str], work, schema: str) -> DataFrame:
    # by a hash: a repartition by the very columns of a join beneath is left out as redundant, and the adaptive planner
    # may then read that join's shuffle by mappers or split it, which parts the rows of a group
    placed = rows.repartition(F.xxhash64(*group)).sortWithinPartitions(*group)
    return placed.mapInPandas(_collect(group, work), schema)


def _grid(rows: DataFrame, sizes: DataFrame, group: list[str], work, block: int, cells: int = 1) -> DataFrame:
    """Complete search in oversized groups: rows meet stored rows cell by cell of a grid; no pair list is made."""
    sized = rows.join(sizes.select(*group, F.greatest(F.lit(cells), F.ceil(F.col("n") / F.lit(block))).cast("long").alias("m")), group)
    place = F.pmod(F.xxhash64("id", F.lit(3)), F.col("m"))
    asking = sized.withColumn("i", place).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).withColumn("stored", F.lit(False))
    kept = sized.where("stored").withColumn("j", place).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    names = [*group, "i", "j", "id", "stored", "vector"]
    # a stored row also asks, so where both meet in one cell it stands there twice
    return _runs(asking.select(*names).unionByName(kept.select(*names)), [*group, "i", "j"], work, CANDIDATES)


# -- without a threshold -----------------------------------------------------------------------------------

#: Rows of a usual bucket; asking entries of one group of buckets, which is what a task holds at a time.
BUCKET_GOAL, GROUP_ASKS = 1024, 1 << 17
#: Documented bounds of the sample that sets the probes: its queries, which are compared with all rows, and the
#: share of their true neighbours that the probes must meet. Tables to choose from; the cheapest sufficient are taken.
FIT_QUERIES, FIT_RECALL, FIT_TABLES = 256, 0.95, (4, 6, 8, 12, 16)
#: So few crowded buckets are told to all tasks; a bucket counts as crowded accordingly.
CROWDED_CODES = 100_000


def bucket_widths(rows: int, size: int, goal: int = BUCKET_GOAL) -> tuple[int, ...]:
    """Axes that each hash of a table looks at: full hashes while more than ``goal`` rows share a bucket, then one of
    the first 2, 4, 8, ... rotated axes."""
    full, need, widths = 1 << max(1, (size - 1).bit_length()), max(1, rows) / goal, []
    while need >= 2 * full:
        widths.append(full)
        need /= 2 * full
    last = 1 << int(np.log2(max(1.0, need / 2)))
    return (*widths, min(full, last)) if need >= 2 or not widths else tuple(widths)


def table_codes(x: np.ndarray, signs: np.ndarray, widths: tuple[int, ...], probes: int) -> np.ndarray:
    """Of every row its bucket in one table and the next ``probes`` likeliest: those of least summed squared shortfall."""
    x = np.pad(x, ((0, 0), (0, signs.shape[2] - x.shape[1]))).astype(np.float32)
    code, cost = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1), np.float32)
    for flips, width in zip(signs, widths):
        y = x
        for s in flips:
            y = _hadamard(y * s)
        signed = np.concatenate([y[:, :width], -y[:, :width]], axis=1)
        axis = np.argsort(-signed, axis=1, kind="stable")[:, : probes + 1]
        value = np.take_along_axis(signed, axis, 1)
        cost = (cost[:, :, None] + ((value[:, :1] - value) ** 2)[:, None, :]).reshape(len(x), -1)
        code = (code[:, :, None] * (2 * width) + axis[:, None, :]).reshape(len(x), -1)
        best = np.argsort(cost, axis=1, kind="stable")[:, : probes + 1]
        code, cost = np.take_along_axis(code, best, 1), np.take_along_axis(cost, best, 1)
    return code


def all_codes(x: np.ndarray, signs: np.ndarray, widths: tuple[int, ...], probes: int, step: int = 2048) -> np.ndarray:
    """Bucket numbers (rows, tables, at most 1 + probes) that differ between tables."""
    tables = len(signs) // len(widths)
    out = [np.zeros((0, tables, 1), np.int64)]
    for i in range(0, len(x), step):
        part = [table_codes(x[i : i + step], signs[t * len(widths) : (t + 1) * len(widths)], widths, probes) * tables + t for t in range(tables)]
        out.append(np.stack(part, axis=1))
    return np.concatenate(out[1:] or out)


def fit_probes(queries: np.ndarray, neighbours: np.ndarray, widths: tuple[int, ...], size: int, seed: int, recall: float = FIT_RECALL) -> tuple[int, int]:
    """(tables, probes) with which ``recall`` of the true ``neighbours`` (queries, k, size) of the sample are met, at least entries."""
    limit = int(np.prod([2 * w for w in widths]))
    most = min(limit, 1024) - 1
    flat = neighbours.reshape(-1, size)
    need = np.zeros((len(queries), neighbours.shape[1], 0), np.int64)
    best = None
    for tables in FIT_TABLES:
        signs = rotations(size, tables * len(widths), seed)
        own = all_codes(flat, signs, widths, 0)[:, need.shape[2] :, 0].reshape(len(queries), neighbours.shape[1], -1)
        asked = all_codes(queries, signs, widths, most)[:, need.shape[2] :]
        # numbers of tables differ with their count: compare without them
        same = (own // tables)[:, :, :, None] == (asked // tables)[:, None, :, :]
        need = np.concatenate([need, np.where(same.any(3), same.argmax(3), limit)], axis=2)
        probes = int(np.quantile(need.min(2), recall, method="higher")) if need.size else 0
        if probes < limit and (best is None or tables * (probes + 2) < best[0] * (best[1] + 2)):
            best = (tables, probes)
    return best or (FIT_TABLES[-1], most)


def _pack(x: np.ndarray) -> list[bytes]:
    return [r.tobytes() for r in x.astype(np.float32)]


def _unpack(column: pd.Series, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float32).reshape(len(column), size)


def _sample_truth(kept: DataFrame, queries: np.ndarray, ids: np.ndarray, k: int, size: int) -> np.ndarray:
    """The ``k`` nearest rows of a bounded set of queries among all rows: (queries, k, size); every batch gives ``k`` a query."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros((len(queries), 0), np.float32), np.zeros((len(queries), 0, size), np.float32))]
        for b in batches:
            x = _scaled(_matrix(b["vector"])).astype(np.float32)
            s = queries @ x.T
            s[ids[:, None] == b["id"].to_numpy()[None, :]] = -3
            at = np.argsort(-s, axis=1, kind="stable")[:, :k]
            value, rows = np.concatenate([best[0][0], np.take_along_axis(s, at, 1)], axis=1), np.concatenate([best[0][1], x[at]], axis=1)
            at = np.argsort(-value, axis=1, kind="stable")[:, :k]
            best = [(np.take_along_axis(value, at, 1), np.take_along_axis(rows, at[:, :, None], 1))]
        value, rows = best[0]
        for q in range(len(queries)):
            if value.shape[1]:
                yield pd.DataFrame({"q": q, "c": value[q].astype(float), "v": _pack(rows[q])})

    found = kept.select("id", "vector").mapInPandas(run, "q int, c double, v binary").where("c > -2")
    top = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("c"), "v"))).where(F.col("r") <= k).orderBy("q", "r").toPandas()
    full = top.groupby("q").filter(lambda g: len(g) == k)
    return _unpack(full["v"], size).reshape(-1, k, size) if len(full) else np.zeros((0, k, size), np.float32)


def _merge(owner: np.ndarray, other: np.ndarray, value: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best distinct others of every owner, ties to the lesser id."""
    # one pair met in several buckets may differ in the last digit
    order = np.lexsort((-value, other, owner))
    owner, other, value = owner[order], other[order], value[order]
    new = np.append(True, (owner[1:] != owner[:-1]) | (other[1:] != other[:-1])) if len(owner) else np.zeros(0, bool)
    owner, other, value = owner[new], other[new], value[new]
    order = np.lexsort((other, -value.round(12), owner))
    owner, other, value = owner[order], other[order], value[order]
    first = np.arange(len(owner)) - np.searchsorted(owner, owner) < k
    return owner[first], other[first], value[first]


def _hashed(kept: DataFrame, size: int, k: int, seed: int, goal: int, bucket_rows: int) -> DataFrame:
    """Candidates (``a``, ``b``, ``cosine``) of rows (``id``, ``vector``), at most ``k`` a row and group of buckets."""
    total = kept.count()
    widths = bucket_widths(total, size, goal)
    sample = kept.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(FIT_QUERIES).toPandas()
    queries = _scaled(_matrix(sample["vector"])).astype(np.float32) if len(sample) else np.zeros((0, size), np.float32)
    truth = _sample_truth(kept, queries, sample["id"].to_numpy(), k, size) if total > k else np.zeros((0, k, size), np.float32)
    tables, probes = fit_probes(queries, truth, widths, size, seed) if len(truth) == len(queries) and total > k else (FIT_TABLES[0], int(np.prod([2 * w for w in widths])) - 1)
    groups = max(1, -(-total * tables * (probes + 1) // GROUP_ASKS))
    crowded_rows = max(bucket_rows, tables * total // CROWDED_CODES)
    made = rotations(size, tables * len(widths), seed)

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"code": all_codes(_scaled(_matrix(b["vector"])), made, widths, 0).reshape(-1)})

    counts = kept.select("vector").mapInPandas(own, "code long").groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    # no more than CROWDED_CODES buckets can hold so many rows
    crowded = np.array(sorted(r[0] for r in counts.where(F.col("n") > crowded_rows).select("code").toLocalIterator()), np.int64)

    def entries(batches: Iterator[pd.DataFrame], of_crowded: bool) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for b in batches:
            if not len(b):
                continue
            x = _scaled(_matrix(b["vector"]).astype(np.float64))
            codes = all_codes(x, made, widths, probes)
            row, _, rank = np.indices(codes.shape)
            code, row, stored = codes.reshape(-1), row.reshape(-1), rank.reshape(-1) == 0
            chosen = np.isin(code, crowded) == of_crowded
            yield b, x, row[chosen], code[chosen], stored[chosen]

    def grouped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b, x, row, code, stored in entries(batches, False):
            group = (code * 0x9E3779B97F4A7C1 % (1 << 61)) % groups
            order = np.lexsort((code, group, row))
            row, code, group, stored = row[order], code[order], group[order], stored[order]
            first = np.nonzero(np.append(True, (row[1:] != row[:-1]) | (group[1:] != group[:-1])))[0] if len(row) else np.zeros(0, int)
            packed, vectors = np.where(stored, -code - 1, code), _pack(x)
            asks = [c.tobytes() for c in np.split(packed, first[1:])] if len(first) else []
            yield pd.DataFrame({"g": group[first], "id": b["id"].to_numpy()[row[first]], "asks": asks, "v": [vectors[i] for i in row[first]]})

    def met(rows: pd.DataFrame, bounds: list[tuple[int, int]]) -> pd.DataFrame:
        out = []
        for i, j in bounds:
            ids, x = rows["id"].to_numpy()[i:j], _scaled(_unpack(rows["v"].iloc[i:j], size).astype(np.float64))
            lists = [np.frombuffer(c, np.int64) for c in rows["asks"].iloc[i:j]]
            code, row = np.concatenate(lists), np.repeat(np.arange(j - i), [len(c) for c in lists])
            stored = code < 0
            code = np.where(stored, -code - 1, code)
            order = np.argsort(code, kind="stable")
            code, row, stored = code[order], row[order], stored[order]
            ends = np.append(np.nonzero(np.append(True, code[1:] != code[:-1]))[0], len(code))
            found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            for p, q in zip(ends, ends[1:]):
                kept_rows = row[p:q][stored[p:q]]
                if q - p > 1 and len(kept_rows):
                    asking = row[p:q]
                    found += _best(ids[asking], x[asking], x[kept_rows], ids[kept_rows], k, -1.5)
            a, b, c = _merge(*(np.concatenate(v) for v in zip(*found)), k)
            first = np.nonzero(np.append(True, a[1:] != a[:-1]))[0] if len(a) else np.zeros(0, int)
            cut = [zip(*(np.split(v, first[1:]) for v in (b, c)))] if len(first) else [[]]
            pairs = [(p.tobytes(), q.tobytes()) for p, q in cut[0]]
            out.append(pd.DataFrame({"a": a[first], "b": [p for p, _ in pairs], "c": [q for _, q in pairs]}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"a": [], "b": [], "c": []})

    placed = kept.select("id", "vector").mapInPandas(grouped, "g long, id long, asks binary, v binary")
    lists = _runs(placed, ["g"], met, "a long, b binary, c binary")
    if len(crowded):

        def alone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b, _, row, code, stored in entries(batches, True):
                yield pd.DataFrame({"bucket": code, "id": b["id"].to_numpy()[row], "stored": stored, "vector": [b["vector"].iloc[i] for i in row]})

        dense = cut_lineage(kept.select("id", "vector").mapInPandas(alone, "bucket long, id long, stored boolean, vector array<float>"))
        sizes = dense.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
        pairs = _grid(dense, sizes, ["bucket"], lambda b, bounds: _candidates(b, bounds, k, -1.5), COMPLETE_BLOCK)

        def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"a": b["a"], "b": [int(v).to_bytes(8, "little", signed=True) for v in b["b"]], "c": [np.float64(v).tobytes() for v in b["cosine"]]})

        lists = lists.unionByName(pairs.mapInPandas(listed, "a long, b binary, c binary"))

    def last(rows: pd.DataFrame, bounds: list[tuple[int, int]]) -> pd.DataFrame:
        size_of = np.array([len(v) // 8 for v in rows["b"]])
        owner = np.repeat(rows["a"].to_numpy(), size_of)
        a, b, c = _merge(owner, np.frombuffer(b"".join(rows["b"]), np.int64), np.frombuffer(b"".join(rows["c"]), np.float64), k)
        return pd.DataFrame({"a": a, "b": b, "cosine": c})

    return _runs(lists, ["a"], last, CANDIDATES)


def nearest(df: DataFrame, id_col: str, vector: str, size: int, k: int, least: float = -1.0, tables: int = TABLES, probes: int = PROBES, hashes: int = HASHES, bucket_rows: int = BUCKET_ROWS, seed: int = 7, complete: bool = False, goal: int = BUCKET_GOAL) -> DataFrame:
    """Rows (``a``, ``b``, ``cosine``, ``rank``): of every vector ``a`` the ``k`` most similar found, at ``least`` or more.

    Takes part: unique long ids with vectors of ``size`` finite components, not all zero; others are left out.
    Ties go to the lesser id. Every vector is indexed; ``least`` only leaves out neighbours below it. Vectors
    whose components differ only by a common factor have cosine 1 but count as copies only if equal.
    ``complete`` compares every vector with every other instead of hashing: nothing is lost, at a cost that is
    quadratic in the rows. With a threshold the given tables and probes are used. Without one (``least`` of -1)
    most true neighbours share no bucket, so as many buckets are made as leave about ``goal`` rows in each, and the
    tables and probes are those that meet ``FIT_RECALL`` of the true neighbours of a sample of ``FIT_QUERIES`` rows.
    """
    rows = df.where(F.col(id_col).isNotNull() & usable(F.col(vector), size)).select(F.col(id_col).cast("long").alias("id"), F.transform(vector, lambda x: x.cast("float")).alias("vector"))
    # two hashes, as with one alone some of very many vectors would pass for copies
    rows = rows.withColumn("copy", F.concat(F.hex(F.xxhash64("vector")), F.lit("-"), F.hex(F.xxhash64("vector", F.lit(1)))))
    # at most k + 1 ids of a copy group go on; partial lists combine before the shuffle
    spread = rows.select("id", "copy", F.pmod("id", F.lit(64)).alias("salt"))
    few = spread.withColumn("r", F.row_number().over(Window.partitionBy("copy", "salt").orderBy("id"))).where(F.col("r") <= k + 1)
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("copy").orderBy("id"))).where(F.col("r") <= k + 1).select("id", F.col("copy"), "r")
    sizes = rows.groupBy("copy").agg(F.count(F.lit(1)).alias("n"))
    kept = cut_lineage(rows.join(few.select("id", "r"), "id"))

    def exact(b: pd.DataFrame, bounds: list[tuple[int, int]]) -> pd.DataFrame:
        return _candidates(b, bounds, k, least)

    if complete:
        every = kept.select(F.lit(0).cast("long").alias("bucket"), "id", F.lit(True).alias("stored"), "vector")
        found = _grid(every, every.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), ["bucket"], exact, COMPLETE_BLOCK, COMPLETE_CELLS)
    elif least <= -1:
        found = _hashed(kept, size, k, seed, goal, bucket_rows)
    else:
        hashed = cut_lineage(kept.select("id", "vector").mapInPandas(_hash(size, tables, hashes, probes, seed), "id long, bucket long, stored boolean, q binary"))
        rough = least - SLACK
        counts = hashed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
        big = cut_lineage(counts.where(F.col("n") > bucket_rows))
        # broadcast: there are only tables x (2 x width) ^ hashes buckets in all, 131,072 as registered
        dense = not big.isEmpty()
        usual = hashed.join(F.broadcast(big.select("bucket")), "bucket", "left_anti") if dense else hashed
        if rough > -1:
            usual = _runs(usual, ["bucket"], lambda b, bounds: _meeting(b, bounds, rough), ALIVE)
        full = kept.select("id", "vector")
        found = _runs(usual.select("bucket", "id", "stored").join(full, "id"), ["bucket"], exact, CANDIDATES)
        if dense:
            crowded = hashed.select("bucket", "id", "stored").join(F.broadcast(big.select("bucket")), "bucket", "left_semi").join(full, "id")
            found = found.unionByName(_grid(crowded, big, ["bucket"], exact, bucket_rows))
    met = found.groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
    order = [F.desc(F.round("cosine", 12)), F.col("b")]
    first = met.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(*order))).where(F.col("rank") <= k)

    # ids beyond the first k + 1 of a group of copies: each is at cosine 1 of those, the least k of them first
    many = sizes.where(F.col("n") > k + 1)
    leads = few.where(F.col("r") <= k).groupBy("copy").agg(F.collect_list(F.struct(F.col("id").alias("b"), F.col("r").alias("rank"))).alias("leads")).join(many, "copy")
    beyond = rows.select("id", "copy").join(few.select("id"), "id", "left_anti")
    rest = lookup_join(beyond, leads, "copy", "n").select(F.col("id").alias("a"), F.inline("leads")).select("a", "b", F.lit(1.0).alias("cosine"), F.col("rank").cast("int").alias("rank"))
    return first.unionByName(rest)


def similar_pairs(neighbours: DataFrame) -> DataFrame:
    """Unordered pairs (``a`` < ``b``) of which one is among the most similar of the other."""
    return neighbours.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
