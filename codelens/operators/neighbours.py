"""Exact cosine top-k neighbours between two sets of vectors.

Small reference sets fit one block: queries are split, each split meets the block
in one cogroup task, and numpy keeps the k best references per query.

Larger ones are pruned, and stay exact:

1. A spread sample of the references (pivots, bounded in bytes) cuts them into
   groups around their nearest pivot. Each group has a radius: the largest angle
   between the pivot and a member. A group of more than a block's rows is split
   into several blocks, so a group of copies of any size is many tasks.
2. Every query first meets the groups of its nearest pivots that together hold k
   references. That gives a lower bound, its k-th similarity so far.
3. No member of a group is nearer than angle(query, pivot) - radius. Groups whose
   bound is below the k-th similarity cannot add a neighbour and are skipped; the
   query meets the blocks of the others, and only references at least as similar as
   its k-th so far are kept.

No pair is ever emitted as a row. A task sees one tile, some blocks of references
that lie side by side, and a bounded split of the queries that visit it: a query is
sent once a tile, with the list of the blocks it needs there. Vectors travel as
Arrow arrays of their own width (a float stays 4 bytes), sized by bytes, and other
columns are only gathered by place. On vectors without any structure nothing can be
skipped and the work is that of all pairs; memory stays bounded all the same, and
what is shuffled is the queries times the tiles and the references times the splits.

Similarities are compared with the k-th so far in single precision, with a margin
above its error; those that pass are computed in double precision.

Keys may be arrays: a row then stands for one in each of its keys, a similarity is
computed once for all keys that both sides share, and vectors are sent once.

Ties: similarity is rounded to 6 decimals and ties go to the smaller reference
id, which is also the order the SQL oracle uses. The skip rule leaves a margin
of two units of that rounding.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from codelens.session import shuffle_width

SIM_DECIMALS = 6
MARGIN = 2 * 10.0**-SIM_DECIMALS
# Similarities are computed for at most this many (query, reference) pairs at
# a time inside a task (8 bytes each, plus a few temporaries): task memory
# stays bounded whatever the block sizes are.
MAX_PAIRS_PER_CHUNK = 1 << 20
# Queries of a split of the plain form, at most: its k neighbours each are the task's result.
SPLIT_ROWS = 1 << 14
# Rows of a pruned split's result, at most, and bytes of its queries.
RESULT_ROWS = 1 << 20
QUERY_BYTES = 32 << 20
# Bytes of vectors in a block, and of all pivots together (they go to every task).
BLOCK_BYTES = 16 << 20
PIVOT_BYTES = 32 << 20
# Full blocks in a tile.
TILE_BLOCKS = 4
# Queries and references whose similarities are computed together.
Q_STEP, R_STEP = 512, 2048
# Array keys, at most (bits of a long); with more, rows are exploded.
MAX_KEYS = 62
# The table of blocks and the number of their splits is broadcast up to this many rows (they are counted).
BROADCAST_MAX_SPLITS = 1_000_000
# Groups for each block's worth of references.
GROUPS_PER_BLOCK = 8


def _matrix(column: pa.ChunkedArray | pa.Array, narrow: bool = False) -> np.ndarray:
    """A list column without null lists as a float64 matrix (``narrow``: floats stay 4 bytes); a null element is NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if not (narrow and flat.dtype == np.float32):
        flat = flat.astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _single(mat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows in single precision (zeros for a row without a direction) and norms, made in steps."""
    units, norms = np.empty(mat.shape, np.float32), np.empty(len(mat))
    for low in range(0, len(mat), R_STEP):
        part = mat[low : low + R_STEP].astype(np.float64, copy=False)
        norms[low : low + R_STEP] = np.linalg.norm(part, axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            units[low : low + R_STEP] = np.nan_to_num(part / norms[low : low + R_STEP, None])
    return units, norms


def _units(mat: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(mat, axis=1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        return mat / norm


def _top_k_block(q_mat, r_ids, r_mat, k):
    """Best k (rounded sim desc, ref id asc) per query row of one block pair.

    Returns (query index, reference index, sim) arrays.
    """
    qn = np.linalg.norm(q_mat, axis=1)
    rn = np.linalg.norm(r_mat, axis=1)
    denom = np.outer(qn, rn)
    # in place: beside the similarities there are their divisors, then one sorted copy
    sims = q_mat @ r_mat.T
    with np.errstate(divide="ignore", invalid="ignore"):
        sims /= denom
    sims[~(denom > 0)] = np.nan
    del denom
    np.round(sims, SIM_DECIMALS, out=sims)
    sims[np.isnan(sims)] = -np.inf
    n_r = r_mat.shape[0]
    kk = min(k, n_r)
    if kk < n_r:
        kth = np.partition(sims, n_r - kk, axis=1)[:, n_r - kk]
        mask = sims >= kth[:, None]  # all rows tied with the k-th stay candidates
    else:
        mask = np.ones_like(sims, dtype=bool)
    mask &= np.isfinite(sims)
    qi, ri = np.nonzero(mask)
    s = sims[qi, ri]
    order = np.lexsort((r_ids[ri], -s, qi))
    qi, ri, s = qi[order], ri[order], s[order]
    # position of each candidate inside its query row
    starts = np.r_[0, np.flatnonzero(np.diff(qi)) + 1]
    counts = np.diff(np.r_[starts, qi.size])
    pos = np.arange(qi.size) - np.repeat(starts, counts)
    keep = pos < k
    return qi[keep], ri[keep], s[keep]


def _finite(vec: str) -> Column:
    """A vector that has a direction: similarities with any other are null."""
    size = F.aggregate(F.col(vec), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    # one evaluation; NaN sorts above infinity
    return F.exists(F.array(size), lambda s: (s > 0) & (s < float("inf")))


def _wide(mat: np.ndarray) -> np.ndarray:
    return mat.astype(np.float64, copy=False)


class _Best:
    """The k best references so far of every query, or of every query and key.

    ``floors`` (queries x keys): similarity below which nothing is looked for; infinite for a
    key that the query does not have. ``keys``: bits, of queries and of references.
    """

    def __init__(self, q_mat, r_mat, r_ids, k, floors, q_keys=None, r_keys=None):
        self.q_mat, self.r_mat, self.r_ids, self.k, self.floors = q_mat, r_mat, r_ids, k, floors
        self.q_keys, self.r_keys, self.n_keys = q_keys, r_keys, floors.shape[1]
        # beside the vectors as they came there are only their units in single precision
        (self.q_unit, self.q_norm), (self.r_unit, self.r_norm) = _single(q_mat), _single(r_mat)
        self.room = np.empty(Q_STEP * R_STEP, np.float32)
        # above what a sum of that many single-precision products can be off
        self.margin = MARGIN + 2 * (q_mat.shape[1] + 4) * 2.0**-24
        self.kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        self.new: list[tuple] = []

    def meet(self, rows: np.ndarray, low: int, high: int) -> None:
        """Queries ``rows`` meet references ``low`` to ``high``."""
        units = self.q_unit[rows]
        for first in range(low, high, R_STEP):
            last = min(first + R_STEP, high)
            sims = np.matmul(units, self.r_unit[first:last].T, out=self.room[: len(rows) * (last - first)].reshape(len(rows), -1))
            least = (self.floors[rows].min(axis=1) - self.margin).astype(np.float32)
            some = np.flatnonzero(sims.max(axis=1) >= least)  # few rows, once there are floors
            hit = sims[some] >= least[some, None]
            many = np.count_nonzero(hit, axis=1) > max(8 * self.k, (last - first) // 16)
            if many.any():
                hit[many] = False
                self._best_of_many(rows[some[many]], sims[some[many]], first, last)
            at = np.flatnonzero(hit)
            if len(at):
                self._add(*self._exact(rows[some[at // (last - first)]], at % (last - first) + first))
            if sum(len(x[0]) for x in self.new) > max(4096, len(self.kept[0]) // 2):
                self.merge()

    def _exact(self, qi: np.ndarray, ri: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, key, reference, similarity) of pairs, one for every key that both have."""
        with np.errstate(divide="ignore", invalid="ignore"):
            sim = np.einsum("ij,ij->i", _wide(self.q_mat[qi]), _wide(self.r_mat[ri])) / (self.q_norm[qi] * self.r_norm[ri])
        sim = np.round(sim, SIM_DECIMALS)
        if self.q_keys is None:
            return qi, np.zeros(len(qi), np.int64), ri, sim
        place, key = np.nonzero(((self.q_keys[qi] & self.r_keys[ri])[:, None] >> np.arange(self.n_keys)) & 1)
        return qi[place], key, ri[place], sim[place]

    def _best_of_many(self, rows: np.ndarray, sims: np.ndarray, first: int, last: int) -> None:
        """For queries without a floor yet, or near to very many references: the most similar ones
        in single precision, and all for the keys of which these may not hold the k best."""
        n = last - first
        some = min(n, 16 * self.k)
        bound = np.partition(sims, n - some, axis=1)[:, n - some]
        hit = sims >= bound[:, None]
        hit[np.count_nonzero(hit, axis=1) > 4 * some] = False  # that many alike
        at = np.flatnonzero(hit)
        qi, key, ri, sim = self._exact(rows[at // n], at % n + first)
        place = np.searchsorted(rows, qi)
        sure = bound + self.margin  # none of those left out is as similar
        of = (place * self.n_keys + key)[sim >= sure[place]]
        held = np.bincount(of, minlength=len(rows) * self.n_keys).reshape(-1, self.n_keys)
        lacking = (held < self.k) & (self.floors[rows] < sure[:, None])
        known = ~lacking[place, key]
        self._add(qi[known], key[known], ri[known], sim[known])
        for key in range(self.n_keys):
            q, r = rows[lacking[:, key]], np.arange(first, last)
            if self.q_keys is not None:
                q, r = q[(self.q_keys[q] >> key) & 1 > 0], r[(self.r_keys[r] >> key) & 1 > 0]
            if len(q) and len(r):
                a, b, sim = _top_k_block(_wide(self.q_mat[q]), self.r_ids[r], _wide(self.r_mat[r]), self.k)
                self._add(q[a], np.full(len(a), key), r[b], sim)

    def _add(self, qi, key, ri, sim) -> None:
        fit = sim >= self.floors[qi, key]  # not if it is null
        self.new.append(((qi * self.n_keys + key)[fit], ri[fit], sim[fit]))

    def merge(self) -> None:
        of, ri, sim = (np.concatenate(x) for x in zip(self.kept, *self.new, strict=True))
        self.new = []
        order = np.lexsort((self.r_ids[ri], -sim, of))
        of, ri, sim = of[order], ri[order], sim[order]
        starts = np.flatnonzero(np.append(True, of[1:] != of[:-1])[: len(of)])
        pos = np.arange(len(of)) - np.repeat(starts, np.diff(np.append(starts, len(of))))
        keep = pos < self.k
        self.kept = of[keep], ri[keep], sim[keep]
        full = np.flatnonzero(pos == self.k - 1)
        at = np.unravel_index(of[full], self.floors.shape)
        self.floors[at] = np.maximum(self.floors[at], sim[full])

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, key, reference, similarity)"""
        self.merge()
        of, ri, sim = self.kept
        return of // self.n_keys, of % self.n_keys, ri, sim


@dataclass
class Groups:
    """Pivots (unit rows), of every group its radius, rows and number of blocks, and of every block its tile."""

    pivots: np.ndarray
    radius: np.ndarray
    rows: np.ndarray
    blocks: np.ndarray
    tiles: np.ndarray

    @property
    def first_block(self) -> np.ndarray:
        return np.cumsum(self.blocks) - self.blocks

    def angles(self, units: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(units @ self.pivots.T, -1.0, 1.0))

    def nearest(self, angle: np.ndarray, enough: float) -> list[np.ndarray]:
        """Of every query the groups of its nearest pivots that hold ``enough`` rows together."""
        n, taken = angle.shape[1], 8
        while True:
            taken = min(taken, n)
            near = np.argpartition(angle, taken - 1, axis=1)[:, :taken]
            near = np.take_along_axis(near, np.argsort(np.take_along_axis(angle, near, axis=1), axis=1, kind="stable"), axis=1)
            held = np.cumsum(self.rows[near], axis=1)
            if taken == n or (held[:, -1] >= enough).all():
                break
            taken *= 2
        need = np.minimum((held < enough).sum(axis=1) + 1, taken)
        return [row[:c] for row, c in zip(near, need, strict=True)]

    def possible(self, angle: np.ndarray, kth: np.ndarray, seen: list) -> np.ndarray:
        """Of every query (a row) the groups, but for those seen, that may hold a vector as similar as its k-th."""
        best = np.cos(np.maximum(0.0, angle - self.radius))
        return (best >= kth[:, None] - MARGIN) & (self.rows > 0) & ~self.mask(seen)

    def mask(self, groups: list) -> np.ndarray:
        out = np.zeros((len(groups), len(self.rows)), bool)
        for i, some in enumerate(groups):
            out[i, np.asarray(some, np.int64)] = True
        return out

    def dealt(self, tile_rows: int) -> np.ndarray:
        """Tiles of the blocks in their order, each of about ``tile_rows`` at most."""
        each = np.repeat(self.rows / np.maximum(1, self.blocks), self.blocks)
        tiles, tile, held = np.zeros(len(each), np.int32), 0, 0.0
        for i, rows in enumerate(each):
            if held and held + rows > tile_rows:
                tile, held = tile + 1, 0.0
            tiles[i], held = tile, held + rows
        return tiles

    def visits(self, mask: np.ndarray) -> pa.Array:
        """Of every query its tiles, each with the blocks it needs there, from a mask of groups."""
        row, block = np.nonzero(np.repeat(mask, self.blocks, axis=1))
        tile = self.tiles[block]
        start = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (tile[1:] != tile[:-1]))[: len(row)])
        need = pa.ListArray.from_arrays(pa.array(np.append(start, len(row)).astype(np.int32)), pa.array(block.astype(np.int32)))
        each = pa.StructArray.from_arrays([pa.array(tile[start].astype(np.int32)), need], names=["_tile", "_need"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(row[start], np.arange(len(mask) + 1)).astype(np.int32)), each)


VISITS = "array<struct<_tile:int,_need:array<int>>>"


def _chunks(batch: pa.RecordBatch, n_groups: int):
    step = max(1, MAX_PAIRS_PER_CHUNK // n_groups)
    for first in range(0, batch.num_rows, step):
        yield batch.slice(first, step)


def _with_columns(df: DataFrame, fn, extra: dict[str, str], vec: str = "_vec") -> DataFrame:
    """``df`` with columns that ``fn(part of an Arrow batch)`` gives; the others pass by in Arrow."""

    def run(batches):
        for batch in batches:
            for part in fn(batch):
                yield part

    fields = [*df.schema.fields, *T.StructType.fromDDL(", ".join(f"{c} {t}" for c, t in extra.items())).fields]
    return df.mapInArrow(run, T.StructType(fields))


def _grouped(ref: DataFrame, n_groups: int, block_rows: int) -> tuple[DataFrame, Groups]:
    """References with group, written once, their block and tile, and the groups."""
    ref = ref.checkpoint(eager=True)
    # a sample spread by hash: bounded by PIVOT_BYTES, whatever the number of references
    sample = ref.select("_vec").orderBy(F.xxhash64("_rid", "_vec")).limit(n_groups).collect()
    pivots = _units(np.array([r[0] for r in sample], np.float64))
    n = len(pivots)
    groups = Groups(pivots, np.zeros(n), np.zeros(n, np.int64), np.ones(n, np.int64), np.zeros(n, np.int32))
    shipped = ref.sparkSession.sparkContext.broadcast(groups)

    def assign(batch):
        for part in _chunks(batch, len(shipped.value.rows)):
            angle = shipped.value.angles(_units(_matrix(part.column("_vec"))))
            group = angle.argmin(axis=1)
            near = angle[np.arange(len(group)), group]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(group.astype(np.int32)), pa.array(near)], names=[*part.schema.names, "_group", "_angle"])

    ref = _with_columns(ref, assign, {"_group": "int", "_angle": "double"}).checkpoint(eager=True)
    for group, rows, radius in ref.groupBy("_group").agg(F.count(F.lit(1)), F.max("_angle")).collect():
        groups.rows[group], groups.radius[group] = rows, radius + 1e-7
        groups.blocks[group] = math.ceil(rows / block_rows)
    groups.tiles = groups.dealt(TILE_BLOCKS * block_rows)
    spark = ref.sparkSession
    ends = np.cumsum(groups.blocks)
    table = spark.createDataFrame(
        [(g, int(ends[g] - b), int(b), groups.tiles[ends[g] - b : ends[g]].tolist()) for g, b in enumerate(groups.blocks)],
        "_group int, _first int, _parts int, _tiles array<int>",
    )
    placed = ref.withColumn("_id", F.monotonically_increasing_id()).join(F.broadcast(table), "_group")
    part = F.pmod(F.xxhash64("_rid", "_vec", "_id"), F.col("_parts").cast("bigint")).cast("int")
    placed = placed.withColumn("_block", F.col("_first") + part).withColumn("_tile", F.get("_tiles", F.col("_block") - F.col("_first")))
    return placed.drop("_id", "_group", "_angle", "_first", "_parts", "_tiles"), groups


def _visits(query: DataFrame, groups: Groups, enough: float) -> DataFrame:
    """Queries with the groups they visit first and those groups' blocks, written once."""
    shipped = query.sparkSession.sparkContext.broadcast(groups)

    def first(batch):
        g = shipped.value
        for part in _chunks(batch, max(len(g.rows), len(g.tiles))):
            near = g.nearest(g.angles(_units(_matrix(part.column("_vec")))), enough)
            seen = pa.array([x.tolist() for x in near], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*part.columns, seen, g.visits(g.mask(near))], names=[*part.schema.names, "_seen", "_visits"])

    rows = query.withColumn("_qrow", F.monotonically_increasing_id())
    return _with_columns(rows, first, {"_seen": "array<int>", "_visits": VISITS}).checkpoint(eager=True)


def _later_visits(query: DataFrame, groups: Groups) -> DataFrame:
    """Queries with ``_kth`` (of every key; null: fewer than k found), and the blocks that may still hold a neighbour."""
    shipped = query.sparkSession.sparkContext.broadcast(groups)
    query = query.checkpoint(eager=True)

    def rest(batch):
        g = shipped.value
        for part in _chunks(batch, max(len(g.rows), len(g.tiles))):
            floors = _floors(_matrix(part.column("_kth")), _bits(part.column("_kq")) if "_kq" in part.schema.names else None)
            found = g.possible(g.angles(_units(_matrix(part.column("_vec")))), floors.min(axis=1), part.column("_seen").to_pylist())
            kept = [c for c in part.schema.names if c != "_seen"]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], g.visits(found)], names=[*kept, "_visits"])

    def run(batches):
        for batch in batches:
            yield from rest(batch)

    kept = [f for f in query.schema.fields if f.name != "_seen"]
    visits = T.StructType.fromDDL(f"_visits {VISITS}").fields
    return query.mapInArrow(run, T.StructType([*kept, *visits])).where(F.size("_visits") > 0)


def _bits(column) -> np.ndarray:
    return column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)


def _floors(kth: np.ndarray, keys: np.ndarray | None) -> np.ndarray:
    """The k-th similarities with minus infinity where there are fewer (NaN), infinity where a query lacks the key."""
    floors = np.where(np.isnan(kth), -np.inf, kth)
    if keys is not None and len(floors):
        floors[((keys[:, None] >> np.arange(floors.shape[1])) & 1) == 0] = np.inf
    return floors


def _meet(query: DataFrame, ref: DataFrame, on: list[str], k: int, q_cols: list[str], r_cols: list[str], schema: T.StructType,
          keys: list | None = None) -> DataFrame:
    """k best references per query (and key) of each pair of parts with equal ``on``.

    With ``_need``, the blocks that a query meets, references have ``_block``; with ``_kth``, only those at least as
    similar are looked for. ``keys``: values of the bits of ``_kq`` and ``_kr``; the result has its key in ``_key``.
    """
    names = [f.name for f in schema.fields]
    n_keys = len(keys) if keys else 1
    key_type = next((f.dataType for f in schema.fields if f.name == "_key"), None)

    def found(q: pa.Table, r: pa.Table) -> tuple:
        if not (q.num_rows and r.num_rows):
            none = np.zeros(0, np.int64)
            return none, none, none, np.zeros(0)
        order, ends, need = None, None, None
        if "_need" in q.column_names:
            block = r.column("_block").to_numpy()
            order = np.argsort(block, kind="stable")
            ends = dict(zip(*(x.tolist() for x in np.unique(block, return_counts=True)), strict=True))
            need = q.column("_need").combine_chunks()
        r_mat, r_ids = _matrix(r.column("_vec"), True), r.column("_rid").to_numpy()
        r_keys = _bits(r.column("_kr")) if keys else None
        if order is not None:
            r_mat, r_ids, r_keys = r_mat[order], r_ids[order], r_keys[order] if keys else None
        q_keys = _bits(q.column("_kq")) if keys else None
        kth = _matrix(q.column("_kth")) if "_kth" in q.column_names else np.full((q.num_rows, n_keys), np.nan)
        floors = _floors(kth, q_keys)
        best = _Best(_matrix(q.column("_vec"), True), r_mat, r_ids, k, floors, q_keys, r_keys)
        parts = []
        for low in range(0, q.num_rows, Q_STEP):
            rows = np.arange(low, min(low + Q_STEP, q.num_rows))
            if need is None:
                best.meet(rows, 0, len(r_mat))
            else:
                some = need.slice(low, len(rows))
                asked, owner = some.flatten().to_numpy(), np.repeat(rows, some.value_lengths().to_numpy())
                at = 0
                for b, n in ends.items():
                    of = owner[asked == b]
                    if len(of):
                        best.meet(of, at, at + n)
                    at += n
            parts.append(best.result())
            best.kept = tuple(x[:0] for x in best.kept)
        qi, key, ri, sim = (np.concatenate(x) for x in zip(*parts, strict=True))
        return qi, key, ri if order is None else order[ri], sim

    def block_pair(q: pa.Table, r: pa.Table) -> pa.Table:
        qi, key, ri, sim = found(q, r)
        left, right = q.select(q_cols).take(pa.array(qi)), r.select(r_cols).take(pa.array(ri))
        columns = {**dict(zip(q_cols, left.columns, strict=True)), **dict(zip(r_cols, right.columns, strict=True))}
        columns["sim"] = pa.array(sim)
        if key_type is not None:
            columns["_key"] = pa.array(keys, to_arrow_type(key_type)).take(pa.array(key))
        return pa.table([columns[n] for n in names], names=names)

    return query.groupBy(*on).cogroup(ref.groupBy(*on)).applyInArrow(block_pair, schema)


def _split_visits(visits: DataFrame, ref: DataFrame, by: list[str], rbys: list[str], split_rows: int) -> tuple[DataFrame, DataFrame]:
    """(query, tile) rows and reference rows, both dealt to the splits that a tile's visitors need."""
    on = [*by, "_tile"]
    tiles = visits.select(*by, F.explode(F.transform("_visits", lambda v: v["_tile"])).alias("_tile"))
    splits = tiles.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / split_rows).cast("int").alias("_splits")).checkpoint(eager=True)
    count, pairs = splits.agg(F.count(F.lit(1)), F.coalesce(F.sum("_splits"), F.lit(0))).first()
    if count <= BROADCAST_MAX_SPLITS:
        splits = F.broadcast(splits)
    each = visits.withColumn("_visit", F.explode("_visits")).drop("_visits", "_seen").select("*", "_visit.*").drop("_visit")
    q = each.join(splits, on).withColumn("_split", F.pmod(F.xxhash64("_qrow"), F.col("_splits").cast("bigint")).cast("int"))
    renamed = ref.withColumnsRenamed(dict(zip(rbys, by, strict=True)))
    r = renamed.join(splits, on).withColumn("_split", F.explode(F.sequence(F.lit(0), F.col("_splits") - 1)))
    q, r = q.drop("_splits"), r.drop("_splits")
    width = min(2 * pairs, 1 << 14)
    if width > shuffle_width(visits.sparkSession):  # few pairs in a partition, so that its sort does not spill
        q, r = q.repartition(width, *on, "_split"), r.repartition(width, *on, "_split")
    return q, r


def search_visits(query: DataFrame, ref: DataFrame, k: int, q_id: str, r_id: str, vec_col: str = "embedding", block_rows: int = 4096, groups: int = 64) -> dict[str, int]:
    """How many (query, block) meetings a pruned search needs, of how many: for sizing and tests."""
    q = query.where(_finite(vec_col)).select(F.col(q_id).alias("_qid"), F.col(vec_col).alias("_vec"))
    r = ref.where(_finite(vec_col)).select(F.col(r_id).alias("_rid"), F.col(vec_col).alias("_vec"))
    first, later, _, g = _rounds(q, r, k, [], [], block_rows, groups, 1, ["_qid"], ["_rid"], _schema(q, r, [], [], ["_qid"], ["_rid"]), block_rows)
    blocks = F.aggregate("_visits", F.lit(0), lambda n, v: n + F.size(v["_need"]))
    met = sum(x.select(F.coalesce(F.sum(blocks), F.lit(0))).first()[0] for x in (first, later))
    return {"met": met, "all": first.count() * int(g.blocks.sum())}


def _schema(q: DataFrame, r: DataFrame, bq: list[str], br: list[str], q_cols: list[str], r_cols: list[str], key: T.DataType | None = None) -> T.StructType:
    fields = [T.StructField(c, q.schema[c].dataType) for c in [*bq, *q_cols]]
    keyed = [T.StructField("_key", key)] if key is not None else []
    return T.StructType([*fields, *[T.StructField(c, r.schema[c].dataType) for c in r_cols], T.StructField("sim", T.DoubleType()), *keyed])


def _rounds(q, r, k, bq, br, block_rows, n_groups, n_by, q_cols, r_cols, schema, split_rows, keys=None):
    """(first visits, later visits, the k best of the first and candidates of the later, groups)."""
    placed, groups = _grouped(r, n_groups, block_rows)
    first = _visits(q, groups, float(k * n_by))
    with_row = T.StructType([T.StructField("_qrow", T.LongType()), *schema.fields])
    on = [*bq, "_tile", "_split"]
    names = [*bq, "_qrow", *q_cols]

    def met(visits: DataFrame) -> DataFrame:
        qs, rs = _split_visits(visits, placed, bq, br, split_rows)
        return _meet(qs, rs, on, k, names, r_cols, with_row, keys)

    key = ["_key"] if keys else []
    rank = F.row_number().over(Window.partitionBy("_qrow", *key).orderBy(F.col("sim").desc(), F.col("_rid")))
    found = met(first).withColumn("_n", rank).where(F.col("_n") <= k).checkpoint(eager=True)
    last = found.where(F.col("_n") == k)
    kth = last.groupBy("_qrow").agg(F.array(*[F.max(F.when(F.col("_key") == v, F.col("sim")) if keys else F.col("sim")) for v in keys or [0]]).alias("_kth"))
    none = F.array(*[F.lit(None).cast("double") for _ in keys or [0]])
    joined = first.join(kth, "_qrow", "left").withColumn("_kth", F.coalesce("_kth", none)).drop("_visits")
    later = _later_visits(joined, groups)
    return first, later, found.drop("_n").unionByName(met(later)), groups


def _key_values(query: DataFrame, ref: DataFrame, name: str) -> list:
    """Values in the arrays of both sides, one more than ``MAX_KEYS`` at most."""
    each = [x.select(F.explode(name).alias("_key")).where(F.col("_key").isNotNull()).distinct() for x in (query, ref)]
    return sorted(x[0] for x in each[0].join(each[1], "_key").limit(MAX_KEYS + 1).collect())


def _as_bits(keys: list, name: str) -> Column:
    """A bit for each of ``keys`` in an array column."""
    bits = F.lit(0).cast("bigint")
    for i, v in enumerate(keys):
        bits = bits.bitwiseOR(F.when(F.array_contains(name, F.lit(v)), F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return bits


def nearest_neighbours(
    query: DataFrame,
    ref: DataFrame,
    k: int,
    q_id: str,
    r_id: str,
    vec_col: str = "embedding",
    q_payload: list[str] | None = None,
    r_payload: list[str] | None = None,
    block_rows: int | None = None,
    min_query_blocks: int | None = None,
    by: list[str] | None = None,
) -> DataFrame:
    """Exact top-k by cosine similarity for every query row.

    ``by``: optional key columns present on both sides (a trial, a fold);
    neighbours are searched only within equal keys, all keys in one job. One of them
    may be an array on both sides, with a row's keys: the output has one key a row.
    ``block_rows``: rows of a block, by default ``BLOCK_BYTES`` of vectors.

    Output: [by], q_id, r_id (renamed ``ref_id`` when the names clash), sim,
    nb_rank (1-based), then the payload columns. Payload names must not clash.
    A row without a vector, or with one of length zero, has no similarity to anything.
    """
    q_payload, r_payload, by = list(q_payload or []), list(r_payload or []), list(by or [])
    spark = query.sparkSession
    query, ref = query.where(_finite(vec_col)), ref.where(_finite(vec_col))
    ref_out = r_id if r_id != q_id else "ref_id"

    sets = next((c for c in by if isinstance(query.schema[c].dataType, T.ArrayType)), None)
    keys = _key_values(query, ref, sets) if sets else None
    if keys is not None and not 1 <= len(keys) <= MAX_KEYS:
        query, ref = (x.withColumn(sets, F.explode(F.array_distinct(F.array_compact(sets)))) for x in (query, ref))
        sets = keys = None
    plain = [c for c in by if c != sets]

    # Block sizes follow the largest group on each side; the sizes come back
    # from one small job (two one-row aggregates).
    size = F.max(F.size(vec_col)).alias("_dim")
    if plain:
        sq = query.groupBy(*plain).count().agg(F.max("count").alias("_nq"), F.count(F.lit(1)).alias("_by"))
        sr = ref.groupBy(*plain).agg(F.count(F.lit(1)).alias("count"), size).agg(F.max("count").alias("_nr"), F.max("_dim").alias("_dim"))
    else:
        sq = query.agg(F.count(F.lit(1)).alias("_nq"), F.lit(1).alias("_by"))
        sr = ref.agg(F.count(F.lit(1)).alias("_nr"), size)
    sizes = sq.crossJoin(sr).first()
    n_q, n_r, dim = sizes["_nq"] or 0, sizes["_nr"] or 0, sizes["_dim"] or 1
    element = ref.schema[vec_col].dataType.elementType
    width = dim * (4 if isinstance(element, T.FloatType) else 8)
    block_rows = block_rows or max(1, BLOCK_BYTES // width)
    par = spark.sparkContext.defaultParallelism if min_query_blocks is None else min_query_blocks

    # key columns get fresh names on each side: both sides may come from one
    # DataFrame (trials, folds), and a cogroup on shared attributes is ambiguous
    bq, br = [f"_by{i}" for i in range(len(plain))], [f"_rby{i}" for i in range(len(plain))]
    bits = lambda name: [_as_bits(keys, sets).alias(name)] if sets else []
    q = query.select(*[F.col(c).alias(b) for c, b in zip(plain, bq)], F.col(q_id).alias("_qid"), F.col(vec_col).alias("_vec"), *bits("_kq"), *q_payload)
    r = ref.select(*[F.col(c).alias(b) for c, b in zip(plain, br)], F.col(r_id).alias("_rid"), F.col(vec_col).alias("_vec"), *bits("_kr"), *r_payload)
    q_cols, r_cols = ["_qid", *q_payload], ["_rid", *r_payload]
    schema = _schema(q, r, bq, br, q_cols, r_cols, ref.schema[sets].dataType.elementType if sets else None)
    n_by = (sizes["_by"] or 1) * (2 * len(keys) if sets else 1)

    if n_r <= block_rows:
        splits = max(1, math.ceil(n_q / min(block_rows, SPLIT_ROWS)), min(par, math.ceil(n_q / 256)))
        q = q.withColumn("_split", F.pmod(F.xxhash64("_qid"), F.lit(splits)).cast("int"))
        r = r.withColumnsRenamed(dict(zip(br, bq))).withColumn("_split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
        partial = _meet(q, r, [*bq, "_split"], k, [*bq, *q_cols], r_cols, schema, keys)
    else:
        n_groups = min(math.ceil(n_r / block_rows) * GROUPS_PER_BLOCK, max(1, PIVOT_BYTES // width))
        split_rows = max(1, min(TILE_BLOCKS * block_rows, QUERY_BYTES // width, RESULT_ROWS // (k * (len(keys) if sets else 1))))
        *_, partial, _ = _rounds(q, r, k, bq, br, block_rows, n_groups, n_by, q_cols, r_cols, schema, split_rows, keys)
    # Several blocks each send up to k candidates: keep the best k.
    # The window also leaves the output hash-partitioned by the query id, so
    # per-query aggregates and windows downstream need no further exchange.
    found_by = {**dict(zip(plain, bq)), **({sets: "_key"} if sets else {})}
    w = Window.partitionBy(*found_by.values(), "_qid").orderBy(F.col("sim").desc(), F.col("_rid"))
    ranked = partial.withColumn("nb_rank", F.row_number().over(w)).where(F.col("nb_rank") <= k)
    return ranked.select(
        *[F.col(found_by[c]).alias(c) for c in by], F.col("_qid").alias(q_id), F.col("_rid").alias(ref_out), "sim", "nb_rank", *q_payload, *r_payload
    )
