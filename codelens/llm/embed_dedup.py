"""Near-duplicate vectors: random hyperplanes in several tables, exact cosines, connected components."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelens.llm.common import connected_components, stored


@dataclass(frozen=True)
class Settings:
    """``miss``: the chance that a pair at exactly ``cosine`` meets in no table.

    ``bucket`` is the number of rows of the largest label that share a signature on
    average; bits follow from it and the rows, tables from bits and ``miss``.
    """

    cosine: float = 0.98
    miss: float = 1e-8
    bucket: int = 16
    most_bits: int = 24
    block: int = 512
    cell_rows: int = 10_000
    seed: int = 13


def planes_needed(largest: int, s: Settings) -> tuple[int, int]:
    """(bits of a signature, tables) for labels of up to ``largest`` rows."""
    bits = min(s.most_bits, max(4, math.ceil(math.log2(max(largest, 1) / s.bucket)) if largest > s.bucket else 4))
    same_bit = 1 - math.acos(s.cosine) / math.pi
    return bits, max(1, math.ceil(math.log(s.miss) / math.log1p(-(same_bit**bits))))


def _prepared(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """id, label, size and the vector as bytes (doubles), for the rows that can link."""

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            sizes = np.array([-1 if x is None else x for x in pc.list_value_length(lists).to_pylist()])
            for size in np.unique(sizes[sizes > 0]).tolist():
                at = np.flatnonzero(sizes == size)
                some = lists.take(pa.array(at))
                values = np.array(some.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(at), size)
                fit = np.isfinite(values).all(1) & (values != 0).any(1)
                at, values = at[fit], values[fit]
                if len(at):
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(np.full(len(at), size), pa.int64()),
                            pa.array([v.tobytes() for v in values], pa.binary()),
                        ],
                        names=["id", "label", "size", "vector"],
                    )

    source = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    return source.where("id is not null and label is not null and v is not null").mapInArrow(run, "id long, label string, size long, vector binary")


def _planes(size: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng((seed, size)).normal(size=(size, bits * tables))


def _signed(classes: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """A row per class and table: table, code (of table, label, size and signature), and all signatures as bytes."""
    weights = (1 << np.arange(bits)).astype(np.int64)

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            size = batch.column("size").to_numpy()
            for k in np.unique(size).tolist():
                if k not in planes:
                    planes[k] = _planes(k, bits, tables, seed)
                at = np.flatnonzero(size == k)
                for first in range(0, len(at), 4096):
                    some = pa.array(at[first : first + 4096])
                    v = np.frombuffer(b"".join(batch.column("vector").take(some).to_pylist())).reshape(-1, k)
                    signs = ((v @ planes[k]) >= 0).reshape(len(v), tables, bits)
                    codes = (signs * weights).sum(2).astype("<i4")
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(c).take(some) for c in ("id", "label", "size", "copies", "vector")), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(list(codes), pa.list_(pa.int32()))],
                        names=["id", "label", "size", "copies", "vector", "codes", "sig"],
                    )

    return classes.mapInArrow(run, "id long, label string, size long, copies long, vector binary, codes binary, sig array<int>")


def _cell_links(cosine: float, tables: int):
    """Links within cells: (id, number of rows linked to it by this cell) and edges that join what the links join."""

    def run(key, table):
        cell, table_no, side = (table[c].to_numpy() for c in ("cell", "table_no", "side"))
        order = np.lexsort((side, cell))
        cell, table_no, side = cell[order], table_no[order], side[order]
        ids, copies = table["id"].to_numpy()[order], table["copies"].to_numpy()[order]
        vectors = [table["vector"][int(i)].as_buffer() for i in order]
        codes = np.frombuffer(b"".join(table["codes"].to_pylist()), "<i4").reshape(-1, tables)[order]
        edges = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])).tolist() + [len(cell)]
        counts: dict[int, int] = {}
        joined: set[tuple[int, int]] = set()
        for begin, end in zip(edges[:-1], edges[1:], strict=True):
            if end - begin < 2:
                continue
            v = np.stack([np.frombuffer(x) for x in vectors[begin:end]])
            top = np.abs(v).max(1, keepdims=True)  # scaled first: squares neither overflow nor vanish
            v = v / top
            v /= np.sqrt((v * v).sum(1, keepdims=True))
            middle = int(np.searchsorted(side[begin:end], 1))
            one = middle == 0 or middle == end - begin  # a cell of one block: pairs within it
            near = (v @ v.T if one else v[:middle] @ v[middle:].T) >= cosine
            i, j = np.nonzero(np.triu(near, 1) if one else near)
            j = j + begin + (0 if one else middle)
            i = i + begin
            t = int(table_no[begin])
            if t and len(i):  # counted in the first table in which the pair meets
                fresh = ~(codes[i, :t] == codes[j, :t]).any(1)
                i, j = i[fresh], j[fresh]
            if not len(i):
                continue
            for x, n in ((i, copies[j]), (j, copies[i])):
                for q, total in zip(*_summed(x, n), strict=True):
                    counts[int(ids[q])] = counts.get(int(ids[q]), 0) + int(total)
            joined.update(_forest(ids[i], ids[j]))
        a = np.array([x for x, _ in joined], np.int64)
        b = np.array([y for _, y in joined], np.int64)
        nodes = np.fromiter(counts, np.int64, len(counts))
        sums = np.fromiter(counts.values(), np.int64, len(counts))
        return pa.table(
            {
                "a": pa.array(np.concatenate([nodes, a])),
                "b": pa.array(np.concatenate([nodes, b]), mask=np.arange(len(nodes) + len(a)) < len(nodes)),
                "n": pa.array(np.concatenate([sums, np.zeros(len(a), np.int64)])),
            }
        )

    return run


def _summed(at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    where, inverse = np.unique(at, return_inverse=True)
    return where, np.bincount(inverse, weights=n).astype(np.int64)


def _forest(a: np.ndarray, b: np.ndarray):
    """Edges (member, smallest member) of the components of the links a-b."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return [(x, root(x)) for x in list(parent) if root(x) != x]


def near_vectors(rows: DataFrame, settings: Settings = Settings(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per input row: id, n_links, component_id, kept (id = component_id).

    Only vectors of equal label and length are compared, in double precision.
    Equal vectors of a label are one class (combined before the shuffle). Every
    class has a signature of signs in each table; the classes of a bucket are
    compared in numpy, bucket by bucket, large buckets in blocks against blocks
    so that no task holds one. A pair is counted in the first table in which it
    meets; of each cell, only sums per class and a spanning forest leave the task.
    Bits and tables follow from the largest label, so that buckets stay small and
    the chance of a miss stays ``miss`` at any size; a pair above ``cosine`` is
    missed more rarely still.

    A vector that is null, zero or has null or non-finite components, and a null
    label or id, link with nothing. Rows that repeat an id are one node each time
    their vectors are equal, and are linked through the id otherwise; links
    between equal vectors count. Extra columns are ignored. An empty table gives
    no rows.
    """
    s = settings
    base = rows.select(F.col(id_col), F.col(label_col), F.col(vector_col))
    fit = stored(_prepared(base, id_col, vector_col, label_col), "vectors")
    classes = fit.groupBy("label", "size", "vector").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    classes = stored(classes, "vector-classes")
    largest = classes.groupBy("label", "size").count().agg(F.max("count")).first()[0] or 0
    bits, tables = planes_needed(int(largest), s)
    signed = stored(_signed(classes, bits, tables, s.seed), "vector-signatures")
    light = signed.select("id", "label", "size", F.posexplode("sig").alias("table_no", "code"))
    bucket = ["label", "size", "table_no", "code"]
    buckets = light.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = stored(buckets.select(*bucket, F.ceil(F.col("n") / s.block).cast("int").alias("blocks")), "vector-buckets")
    heavy = signed.select("id", "label", "size", "copies", "vector", "codes", F.posexplode("sig").alias("table_no", "code")).join(buckets, bucket)
    mine = F.pmod(F.xxhash64("id", F.lit(s.seed)), "blocks").cast("int")
    cells = heavy.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select(
        "id", "copies", "vector", "codes", "table_no", (F.col("mine") > F.col("other")).cast("int").alias("side"),
        F.xxhash64(*bucket, F.least("mine", "other"), F.greatest("mine", "other")).alias("cell"),
    )
    n = buckets.agg(F.count(F.lit(1))).first()[0]
    groups = max(1, int(classes.count() * tables // s.cell_rows), int(n * 2 // s.cell_rows))
    found = cells.groupBy(F.pmod(F.xxhash64("cell"), F.lit(groups)).alias("part")).applyInArrow(_cell_links(s.cosine, tables), "a long, b long, n long")
    found = stored(found, "vector-links")
    components = connected_components(found.where("b is not null").select("a", "b"))
    counts = stored(found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n")), "vector-counts")
    named = (
        classes.join(counts, "id", "left")
        .join(components.withColumnRenamed("node", "id"), "id", "left")
        .select(
            "label", "size", "vector", F.coalesce("component", "id").alias("component"),
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links"),
        )
    )
    named = stored(named, "vector-named")
    placed = fit.join(named, ["label", "size", "vector"]).select("id", "component", "links")
    placed = stored(placed.groupBy("id").agg(F.min("component").alias("component"), F.max("links").alias("links")), "vector-placed")
    out = rows.select(F.col(id_col).alias("__id")).join(placed, F.col("__id").cast("long") == F.col("id"), "left")
    component = F.coalesce("component", F.col("__id").cast("long"))
    return out.select(
        F.col("__id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("__id").cast("long").eqNullSafe(component).alias("kept"),
    )


def oracle_sql(cosine: float) -> str:
    return f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= {cosine}),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a)
SELECT e.vec_id, (SELECT count(*) FROM p WHERE p.a = e.vec_id) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c USING (vec_id)
"""
