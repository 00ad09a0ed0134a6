"""Packing documents into training windows with their lexical neighbours."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelens.llm.common import shuffle_width, stored
from codelens.llm.tokens import encoded, id_type, term_counts

WINDOW = 2048
SHARD_TOKENS = 1 << 20
K1, B = 1.2, 0.75
#: Sampled terms that rows are ordered by.
DRAWS = 4


class ShardIndex:
    """Inverted BM25 index of one shard's documents, with the whole corpus's frequencies."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, idf: np.ndarray, mean_size: float):
        n = len(sizes)
        docs, terms, counts = term_counts(ids, sizes)
        telling = idf[terms] > 0
        docs, terms, counts = docs[telling], terms[telling], counts[telling]
        norm = K1 * (1 - B + B * sizes / max(mean_size, 1.0))
        weight = idf[terms] * counts * (K1 + 1) / (counts + norm[docs])
        self.terms_of = np.split(terms, np.searchsorted(docs, np.arange(1, n)))
        order = np.argsort(terms.astype(ids.dtype), kind="stable")
        self.docs, self.weights = docs[order].astype(np.int32), weight[order]
        self.begin = np.concatenate(([0], np.cumsum(np.bincount(terms, minlength=len(idf)))))
        self.n = n

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document for the seed's distinct terms."""
        terms = self.terms_of[seed]
        begin, size = self.begin[terms], self.begin[terms + 1] - self.begin[terms]
        at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return np.bincount(self.docs[at], weights=self.weights[at], minlength=self.n)


def _falling(scores: np.ndarray, free: np.ndarray, some: int = 32):
    """The places ``free`` by falling score, ties by place; only as many are put in order as are asked for."""
    cost = -scores[free]
    while len(free):
        if some < len(free):
            last = np.partition(cost, some - 1)[some - 1]
            now = cost <= last
        else:
            now = np.ones(len(free), bool)
        yield from free[now][np.argsort(cost[now], kind="stable")].tolist()
        free, cost, some = free[~now], cost[~now], some * 8


def pack_shard(ids: np.ndarray, sizes: np.ndarray, idf: np.ndarray, mean_size: float, window: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece.

    A window begins with what is left of the last window's cut document, or with
    the first unused document. When the seed leaves room, its unused neighbours
    follow by falling score (ties by position); the one that does not fit is cut
    and seeds the next window. Windows are therefore full up to the shard's last
    tokens, which go into windows whose lengths are powers of two.
    """
    index = ShardIndex(ids, sizes, idf, mean_size)
    n, pieces = len(sizes), []
    unused = np.ones(n, bool)
    next_unused, seed, start, sequence = 0, -1, 0, 0
    left = int(sizes.sum())

    def fill(room: int) -> None:
        nonlocal next_unused, seed, start, sequence
        offset, waiting = 0, None
        while offset < room:
            if seed < 0:
                if waiting is None:
                    while not unused[next_unused]:
                        next_unused += 1
                    seed = next_unused
                else:
                    seed = next(waiting)
                unused[seed], start = False, 0
            take = min(room - offset, int(sizes[seed]) - start)
            if take:
                pieces.append((seed, start, take, sequence, offset))
            offset, start = offset + take, start + take
            if start == sizes[seed]:
                if waiting is None and offset < room:
                    waiting = _falling(index.scores(seed), np.flatnonzero(unused))
                seed = -1
        sequence += 1

    while left >= window:
        fill(window)
        left -= window
    for bit in reversed(range(window.bit_length())):
        if left >> bit & 1:
            fill(1 << bit)
    return pieces


def pack(
    docs: DataFrame, tokenizer_json: str, end_id: int = 1, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Pieces of documents laid out in windows of at most ``window`` tokens.

    One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, and ``ids`` (the piece's ids, little-endian unsigned 32-bit).

    Texts are encoded once into a written table. Document frequencies of all
    ids are counted over the whole corpus (one partial table per task, summed by
    Spark; at most one row per id of the vocabulary comes back). Rows are dealt
    to shards of about ``shard_tokens`` tokens by content (``shards_of``), and
    each shard builds its inverted index and packs its rows; neighbours are
    looked for within the shard. Shards fit a task's memory at any corpus
    size; a document larger than a shard only makes its own shard larger.

    Null and empty texts are the end id alone. Ties go by position in the shard
    (id, then row). Rows that repeat an id are packed each. Extra columns are
    ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    table = encoded(docs, tokenizer_json, end_id, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    table = stored(table.select(F.col(id_col).alias("id"), "row", "n_tokens", "ids"), "packing-tokens")
    stored_as = id_type(tokenizer_json, end_id)
    vocabulary = table.select("n_tokens", "ids").mapInArrow(lambda b: _document_frequencies(b, stored_as), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    frequency = vocabulary.toPandas()
    n_docs, n_tokens = table.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    df = np.zeros(int(frequency["term"].max()) + 1 if len(frequency) else 1)
    df[frequency["term"].to_numpy(np.int64)] = frequency["df"].to_numpy()
    weights = np.maximum(0.0, np.log((n_docs - df + 0.5) / (df + 0.5)))
    idf = spark.sparkContext.broadcast(weights)
    mean_size = n_tokens / max(n_docs, 1)
    dealt = shards_of(table, np.where(df > 1, weights, 0.0), stored_as, shard_tokens)

    def run(key, group):
        group = group.sort_by([("id", "ascending"), ("row", "ascending")])
        sizes = group["n_tokens"].to_numpy().astype(np.int64)
        blobs = group["ids"].to_pylist()
        short = np.frombuffer(b"".join(blobs), stored_as)
        ids = short.astype("<u4")
        edges = np.concatenate(([0], np.cumsum(sizes)))
        pieces = np.array(pack_shard(short, sizes, idf.value, mean_size, window), np.int64).reshape(-1, 5)
        doc, start, length, sequence, offset = pieces.T
        cut = [ids[a : a + n].tobytes() for a, n in zip((edges[doc] + start).tolist(), length.tolist(), strict=True)]
        return pa.table(
            {
                "id": group["id"].take(pa.array(doc)), "start": start, "length": length,
                "ids_crc32": pa.array([zlib.crc32(c) for c in cut], pa.int64()),
                "doc_tokens": sizes[doc], "sequence_id": (np.int64(key[0].as_py()) << 32) + sequence, "offset": offset,
                "ids": pa.array(cut, pa.binary()),
            }
        )

    kind = docs.schema[id_col].dataType.simpleString()
    packed = table.join(dealt, "row").groupBy("shard").applyInArrow(
        run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    )
    return packed.withColumnRenamed("id", id_col)


def shards_of(table: DataFrame, weights: np.ndarray, stored_as: str, shard_tokens: int) -> DataFrame:
    """(row, shard): rows that are alike next to each other, cut every ``shard_tokens`` tokens.

    Of every row ``DRAWS`` terms are drawn by weighted min-hash (two rows draw the
    same term about as often as they share weight), and rows are ordered by them:
    near copies agree in all, rows of a topic in the first ones. Ranges of that
    order are sampled by Spark and include the row number, so that a large group
    of copies is cut too; the driver gets one token count per range.
    """
    spark = table.sparkSession
    with np.errstate(divide="ignore"):
        race = np.random.default_rng(7).exponential(size=(DRAWS, len(weights))) / weights
    shipped = spark.sparkContext.broadcast(race)
    names = [f"draw{i}" for i in range(DRAWS)]

    def draws(batches):
        for batch in batches:
            sizes = batch.column(1).to_numpy().astype(np.int64)
            found = []
            for first in range(0, len(sizes), 256):
                some = sizes[first : first + 256]
                ids = np.frombuffer(b"".join(batch.column(2).slice(first, 256).to_pylist()), stored_as)
                docs, terms, counts = term_counts(ids, some)
                tf = counts * (K1 + 1) / (counts + K1)
                taken = np.full((DRAWS, len(some)), -1, np.int64)
                begin = np.searchsorted(docs, np.arange(len(some)))
                with_terms = np.flatnonzero(np.diff(begin, append=len(docs)))
                for k in range(DRAWS if len(docs) else 0):
                    time = shipped.value[k][terms] / tf
                    least = np.full(len(some), np.inf)
                    least[with_terms] = np.minimum.reduceat(time, begin[with_terms])
                    won = np.flatnonzero((time == least[docs]) & np.isfinite(time))
                    taken[k, docs[won]] = terms[won]
                found.append(taken)
            taken = np.concatenate(found, axis=1) if found else np.zeros((DRAWS, 0), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x) for x in taken)], names=["row", "n_tokens", *names])

    def running(batches):
        before, at = 0, TaskContext.get().partitionId()
        for batch in batches:
            sizes = batch.column(1).to_numpy()
            ends = before + np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ends - sizes), pa.array(np.full(len(sizes), at, np.int32))], names=["row", "n_tokens", "before", "range"]
            )
            before = int(ends[-1]) if len(ends) else before

    drawn = stored(table.select("row", "n_tokens", "ids").mapInArrow(draws, "row long, n_tokens long, " + ", ".join(f"{n} long" for n in names)), "packing-draws")
    order = [*names, "row"]
    ranged = drawn.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order)
    placed = stored(ranged.select("row", "n_tokens").mapInArrow(running, "row long, n_tokens long, before long, range int"), "packing-places")
    offsets, total = [], 0
    for r in placed.groupBy("range").agg(F.sum("n_tokens").alias("n")).orderBy("range").collect():
        offsets.append((r["range"], total))
        total += r["n"]
    offset = spark.createDataFrame(offsets, "range int, offset long")
    return placed.join(F.broadcast(offset), "range").select("row", F.floor((F.col("offset") + F.col("before")) / F.lit(shard_tokens)).cast("long").alias("shard"))


def _document_frequencies(batches, stored_as):
    counts = np.zeros(0, np.int64)
    for batch in batches:
        blobs = batch.column(batch.schema.get_field_index("ids"))
        sizes = batch.column(batch.schema.get_field_index("n_tokens")).to_numpy()
        for first in range(0, len(sizes), 256):
            some = sizes[first : first + 256]
            ids = np.frombuffer(b"".join(blobs.slice(first, 256).to_pylist()), stored_as)
            terms = term_counts(ids, some)[1]
            found = np.bincount(terms, minlength=len(counts))
            found[: len(counts)] += counts
            counts = found
    terms = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int64()), pa.array(counts[terms], pa.int64())], names=["term", "df"])
