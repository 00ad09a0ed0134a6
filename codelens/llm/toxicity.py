"""Toxicity: a convolutional text classifier trained in numpy."""

from __future__ import annotations

import copy
import io
import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark import Broadcast, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelens.llm.common import discard, stored, worker_state
from codelens.llm.tokens import slices

_TO_SPACE = str.maketrans({c: " " for c in string.punctuation})
#: Rows for words in a network's table. Words beyond it share rows, so a network's size has a bound.
HASH_SPACE = 1 << 20
#: Rows of the table whose changes are averaged together.
PIECE = 2048
#: Words that are scored at once, about: bounded memory, and a processor's cache holds them.
WORDS_AT_ONCE = 8_000
#: Labels are broadcast up to this many rows (they are counted).
BROADCAST_MAX_LABELS = 1_000_000


@dataclass(frozen=True)
class Settings:
    """``max_toxic`` and ``max_clean``: about the most rows of a shard, which one task learns from.

    The first shard is gone through ``epochs`` times, a small one more often, until
    ``least_steps`` steps are made. Where there are more shards, all are gone through
    ``rounds`` times after that, and their networks averaged each time.
    """

    max_toxic: int = 3000
    max_clean: int = 6000
    width_sizes: tuple[int, ...] = (1, 2, 3)
    filters: int = 12
    size: int = 12
    least_documents: int = 5
    epochs: int = 10
    rounds: int = 2
    least_steps: int = 1500
    batch: int = 32
    rate: float = 0.05
    drop_words: float = 0.5
    folds: int = 5
    seed: int = 11


def words_of(text: bytes) -> list[str]:
    """Lower-cased words; ASCII punctuation and white space part them."""
    return text.decode("utf-8", "replace").lower().translate(_TO_SPACE).split()


def word_hash(word: str) -> int:
    return xxhash.xxh32_intdigest(word) % HASH_SPACE + 1


class Network:
    """Hashed word embeddings, filters of several widths, max pooling, one logistic unit.

    Only hashes seen in ``least_documents`` training texts have a vector; row 0,
    always zero, stands for every other word and for the gaps between texts.
    """

    def __init__(self, hashes: np.ndarray, embedding: np.ndarray, filters: list[np.ndarray], bias: np.ndarray, out: np.ndarray, out_bias: float):
        self.hashes, self.embedding, self.filters = hashes, embedding, filters
        self.bias, self.out, self.out_bias = bias, out, out_bias

    @staticmethod
    def fresh(hashes: np.ndarray, s: Settings) -> Network:
        rng = np.random.default_rng(s.seed)
        embedding = rng.normal(0, 0.1, (len(hashes) + 1, s.size)).astype(np.float32)
        embedding[0] = 0
        filters = [rng.normal(0, (w * s.size) ** -0.5, (w, s.size, s.filters)).astype(np.float32) for w in s.width_sizes]
        n = s.filters * len(s.width_sizes)
        return Network(hashes, embedding, filters, np.zeros(n, np.float32), rng.normal(0, 0.3, n).astype(np.float32), 0.0)

    def rows(self, hashed: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(hashed), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashed), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashed, at + 1, 0)

    def saved(self) -> bytes:
        buffer = io.BytesIO()
        np.savez(buffer, h=self.hashes, e=self.embedding, b=self.bias, o=self.out, ob=self.out_bias, **{f"f{i}": f for i, f in enumerate(self.filters)})
        return buffer.getvalue()

    @staticmethod
    def loaded(blob: bytes) -> Network:
        with np.load(io.BytesIO(blob)) as z:
            return Network(z["h"], z["e"], [z[f"f{i}"] for i in range(sum(k[0] == "f" for k in z.files))], z["b"], z["o"], float(z["ob"]))

    def responses(self, rows: np.ndarray) -> list[np.ndarray]:
        """Of every filter at every place; ``rows`` ends with as many zeros as the widest filter needs."""
        widest = max(len(f) for f in self.filters)
        n, out = len(rows) - widest + 1, []
        x = self.embedding[rows]
        for f in self.filters:
            y = x[:n] @ f[0]
            for k in range(1, len(f)):
                y += x[k : k + n] @ f[k]
            out.append(y)
        return out

    def logits(self, texts: list[np.ndarray]) -> np.ndarray:
        rows, begin = laid_out(texts, max(len(f) for f in self.filters))
        best = np.hstack([np.maximum.reduceat(y, begin, axis=0) for y in self.responses(rows)]) if len(texts) else np.zeros((0, len(self.out)))
        return np.maximum(best + self.bias, 0) @ self.out + self.out_bias


def laid_out(texts: list[np.ndarray], widest: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts in one row with ``widest`` zeros after each, and where each begins; an empty text is a zero."""
    gap = np.zeros(widest, np.int64)
    begin = np.cumsum([0] + [len(t) + widest for t in texts])
    return np.concatenate([x for t in texts for x in (t, gap)] + [gap]), begin[:-1]


def state_of(net: Network) -> list[np.ndarray]:
    """The sums of squared gradients before the first step."""
    return [np.full_like(p, 1e-4) for p in (net.embedding, *net.filters, net.bias, net.out)] + [np.full(1, 1e-4)]


def train(net: Network, sums: list[np.ndarray], texts: list[np.ndarray], labels: np.ndarray, s: Settings, epochs: int, seed: int) -> None:
    """Go on learning, in place, by Adagrad on the logistic loss; pooling sends each gradient to one place."""
    texts = [net.rows(t) for t in texts]
    rng = np.random.default_rng(seed)
    widest = max(s.width_sizes)
    for _ in range(epochs if texts else 0):
        order = rng.permutation(len(texts))
        for first in range(0, len(order), s.batch):
            some = order[first : first + s.batch]
            rows, begin = laid_out([texts[i] for i in some], widest)
            rows = np.where(rng.random(len(rows)) < s.drop_words, 0, rows)
            ends = np.append(begin[1:], len(rows) - widest)
            places, best = [], []
            for y in net.responses(rows):
                at = np.array([y[b:e].argmax(0) + b for b, e in zip(begin, ends, strict=True)])
                places.append(at)
                best.append(np.take_along_axis(y, at, 0))
            pooled = np.hstack(best) + net.bias
            live = np.maximum(pooled, 0)
            p = 1 / (1 + np.exp(-np.clip(live @ net.out + net.out_bias, -30, 30)))
            error = ((p - labels[some]) / len(some)).astype(np.float32)
            g_out, g_bias_out = live.T @ error, float(error.sum())
            g_pool = np.outer(error, net.out) * (pooled > 0)
            g_filters = [np.zeros_like(f) for f in net.filters]
            touched, g_rows = [], []
            for i, f in enumerate(net.filters):
                g = g_pool[:, i * s.filters : (i + 1) * s.filters]
                for k in range(len(f)):
                    r = rows[places[i] + k]
                    g_filters[i][k] = np.einsum("bfd,bf->df", net.embedding[r], g)
                    touched.append(r.ravel())
                    g_rows.append((g[:, :, None] * f[k].T[None]).reshape(-1, s.size))
            row, inverse = np.unique(np.concatenate(touched), return_inverse=True)
            g_embedding = np.zeros((len(row), s.size), np.float32)
            np.add.at(g_embedding, inverse, np.concatenate(g_rows))
            g_embedding[row == 0] = 0
            sums[0][row] += g_embedding**2
            net.embedding[row] -= s.rate * g_embedding / np.sqrt(sums[0][row])
            for value, g, total in zip((*net.filters, net.bias, net.out), (*g_filters, g_pool.sum(0), g_out), sums[1:-1], strict=True):
                total += g**2
                value -= s.rate * g / np.sqrt(total)
            sums[-1] += g_bias_out**2
            net.out_bias -= s.rate * g_bias_out / float(sums[-1][0]) ** 0.5


#: Toxic rows that a threshold is calibrated on, at least.
LEAST_TO_CALIBRATE = 20


def best_threshold(scores: np.ndarray, labels: np.ndarray, times: np.ndarray | None = None) -> float:
    """The score from which on F1 is largest; 0.5 with too few toxic rows to tell. ``times``: rows that each entry stands for."""
    times = np.ones(len(labels)) if times is None else times
    total = (labels * times).sum()
    if not LEAST_TO_CALIBRATE <= total < times.sum():
        return 0.5
    order = np.argsort(-scores, kind="stable")
    hits = np.cumsum((labels * times)[order])
    f1 = 2 * hits / (np.cumsum(times[order]) + total)
    last = np.append(scores[order][1:] != scores[order][:-1], True)
    k = int(np.argmax(np.where(last, f1, -1)))
    below = scores[order][k + 1] if k + 1 < len(labels) else 0.0
    return float((scores[order][k] + below) / 2)


def _hashed(batches):
    """Of (key, text, lang, toxic) rows the words' hashes, four bytes each, in place of the text."""
    known: dict[str, int] = {}
    worker_state("toxicity")  # what another operator left in this worker goes
    for batch in batches:
        for first, texts in slices(batch.column(batch.schema.get_field_index("text"))):
            if len(known) > 300_000:
                known.clear()
            words = [words_of(t) for t in texts]
            known.update((w, word_hash(w)) for ws in words for w in ws if w not in known)
            found = [np.fromiter(map(known.__getitem__, ws), np.uint32, len(ws)).tobytes() for ws in words]
            part = batch.slice(first, len(texts))
            kept = ["key", "lang", "toxic"]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(found, pa.binary())], names=[*kept, "words"])


def _unpacked(words: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(w, np.uint32).astype(np.int64) for w in words.to_pylist()]


def _document_counts(folds: int):
    """Per fold and hash the documents of a task's rows (fold, words) that have it."""

    def run(batches):
        n = np.zeros((folds, HASH_SPACE + 1), np.int64)
        for batch in batches:
            for fold, words in zip(batch.column("fold").to_pylist(), _unpacked(batch.column("words")), strict=True):
                n[fold, np.unique(words)] += 1
        fold, at = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(fold.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(n[fold, at])], names=["fold", "hash", "n"])

    return run


def _dense(net: Network, sums: list[np.ndarray]) -> np.ndarray:
    """All that is learned but the words' vectors, in one row, with the sums that belong to it."""
    return np.concatenate([x.ravel() for x in (*net.filters, net.bias, net.out, np.array([net.out_bias]), *sums[1:])]).astype(np.float64)


def _add_dense(net: Network, sums: list[np.ndarray], change: np.ndarray) -> None:
    parts = [*net.filters, net.bias, net.out, np.zeros(1), *sums[1:]]
    cuts = np.cumsum([x.size for x in parts])[:-1]
    for x, d in zip(parts, np.split(change, cuts), strict=True):
        x += d.reshape(x.shape).astype(x.dtype)
    net.out_bias += float(parts[len(net.filters) + 2][0])


TYPES = (("net", pa.int32()), ("piece", pa.int32()), ("rows", pa.binary()), ("values", pa.binary()))
CHANGES = "net int, piece int, rows binary, values binary"


def _first_shard(table: pa.Table, s: Settings, hashes: np.ndarray, nets: np.ndarray) -> pa.Table:
    """What of the network ``net`` the first shard's rows change, without those of the fold of this number."""
    worker_state("toxicity")
    held, table = table["net"][0].as_py(), table.sort_by("key")
    table = table.filter(pa.compute.not_equal(table["fold"], held))
    net = Network.fresh(_kept(hashes, nets, held), s)
    sums = state_of(net)
    before = copy.deepcopy((net, sums))
    steps = -(-table.num_rows // s.batch)
    train(net, sums, _unpacked(table["words"]), table["toxic"].to_numpy().astype(np.float32), s, max(s.epochs, -(-s.least_steps // max(1, steps))), s.seed + 1)
    return _change(held, before, (net, sums), values=True)


def _kept(hashes: np.ndarray, nets: np.ndarray, net: int) -> np.ndarray:
    """The hashes that a network has a vector for: bit ``net`` of ``nets`` is set."""
    return hashes[nets >> net & 1 == 1]


def _changes(table: pa.Table, s: Settings, k: int, state: tuple[Network, list[np.ndarray]], turn: int) -> pa.Table:
    """What network ``k`` changes by as it goes through a shard once, without the rows of the fold of this number."""
    worker_state("toxicity")
    table = table.sort_by("key")
    shard = table["shard"][0].as_py()
    table = table.filter(pa.compute.not_equal(table["fold"], k))
    if not table.num_rows:
        return pa.table([pa.array([], t) for _, t in TYPES], names=[n for n, _ in TYPES])
    net, sums = copy.deepcopy(state)
    train(net, sums, _unpacked(table["words"]), table["toxic"].to_numpy().astype(np.float32), s, 1, s.seed + 2 + turn * 1_000_003 + shard)
    return _change(k, state, (net, sums))


def _change(k: int, before: tuple[Network, list[np.ndarray]], after: tuple[Network, list[np.ndarray]], values: bool = False) -> pa.Table:
    """(net, piece, rows, values) from one state of network ``k`` to another.

    Piece -1 is all but the words' vectors; the others hold the words whose vectors
    change, as half floats, which halves what is shuffled. ``values``: what they change
    to, in full.
    """
    (old, old_sums), (net, sums) = before, after
    out = [(k, -1, b"", (_dense(net, sums) - (0 if values else _dense(old, old_sums))).tobytes())]
    for piece, first in enumerate(range(0, len(net.embedding), PIECE)):
        of = slice(first, first + PIECE)
        now = np.hstack([net.embedding[of], sums[0][of]])
        change = now - np.hstack([old.embedding[of], old_sums[0][of]])
        some = np.flatnonzero(change.any(axis=1))
        if len(some):
            found = now[some] if values else change[some].astype(np.float16)
            out.append((k, piece, (some + first).astype(np.int32).tobytes(), found.tobytes()))
    return pa.table([pa.array([x[i] for x in out], t) for i, (_, t) in enumerate(TYPES)], names=[n for n, _ in TYPES])


def _apply(state: tuple[Network, list[np.ndarray]], found: pa.Table, values: bool = False) -> None:
    """Add changes (piece, rows, values), those of words as floats, to a state in place; ``values``: put them there."""
    net, sums = state
    if values and found.num_rows:
        net.out_bias = 0.0
        for x in (*net.filters, net.bias, net.out, *sums[1:]):
            x[:] = 0
    for batch in found.to_batches():
        for piece, rows, numbers in zip(batch["piece"].to_pylist(), batch["rows"], batch["values"], strict=True):
            if piece < 0:
                _add_dense(net, sums, np.frombuffer(numbers.as_buffer(), np.float64))
            else:
                at = np.frombuffer(rows.as_buffer(), np.int32)
                change = np.frombuffer(numbers.as_buffer(), np.float32).reshape(len(at), -1)
                if values:
                    net.embedding[at] = sums[0][at] = 0
                net.embedding[at] += change[:, : net.embedding.shape[1]]
                sums[0][at] += change[:, net.embedding.shape[1] :]


def _averaged(table: pa.Table) -> pa.Table:
    """The mean change of a piece over the shards; that of a word's vector over the shards that have the word."""
    net, piece = table["net"][0].as_py(), table["piece"][0].as_py()
    if piece < 0:
        rows, values = b"", np.mean([np.frombuffer(v, np.float64) for v in table["values"].to_pylist()], axis=0).tobytes()
    else:
        total, times = None, np.zeros(PIECE, np.int64)
        for r, v in zip(table["rows"], table["values"], strict=True):
            at = np.frombuffer(r.as_py(), np.int32) - piece * PIECE
            change = np.frombuffer(v.as_py(), np.float16).reshape(len(at), -1)
            total = np.zeros((PIECE, change.shape[1])) if total is None else total
            total[at] += change
            times[at] += 1
        at = np.flatnonzero(times)
        rows, values = (at + piece * PIECE).astype(np.int32).tobytes(), (total[at] / times[at, None]).astype(np.float32).tobytes()
    return pa.table([pa.array([net], pa.int32()), pa.array([piece], pa.int32()), pa.array([rows], pa.binary()), pa.array([values], pa.binary())], names=table.column_names)


def _fold_scores(shipped: Broadcast):
    """(score, lang, toxic) of rows (words, lang, toxic) by a network that has not seen them."""

    def run(batches):
        net = Network.loaded(shipped.value)
        for batch in batches:
            words = batch.column("words")
            scores = np.zeros(batch.num_rows)
            for some in _runs(np.arange(batch.num_rows), words):
                scores[some] = sigmoid(net.logits([net.rows(t) for t in _unpacked(words.take(pa.array(some)))]))
            yield pa.RecordBatch.from_arrays([pa.array(scores), batch.column("lang"), batch.column("toxic")], names=["score", "lang", "toxic"])

    return run


def _runs(places: np.ndarray, words: pa.Array, most: int = WORDS_AT_ONCE):
    """``places`` in runs of about ``most`` words: bounded memory."""
    run, size = [], 0
    for i in places:
        run.append(i)
        size += len(words[int(i)].as_buffer()) // 4 + 1
        if size > most:
            yield np.array(run)
            run, size = [], 0
    if run:
        yield np.array(run)


def calibrated(scores: np.ndarray, toxic: np.ndarray, langs: np.ndarray, times: np.ndarray) -> dict[str, float]:
    """The common threshold (under "") and that of each language with toxic rows enough; an entry stands for ``times`` rows."""
    found = {"": best_threshold(scores, toxic, times)}
    for x in np.unique(langs[langs != ""]):
        of = langs == x
        if (toxic[of] * times[of]).sum() >= LEAST_TO_CALIBRATE:
            found[str(x)] = best_threshold(scores[of], toxic[of], times[of])
    return found


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    blob: bytes
    thresholds: dict[str, float]

    def threshold(self, lang: Column) -> Column:
        """Calibrated by language; the common one for a language with few toxic rows."""
        out = F.lit(self.thresholds.get("", 0.5))
        for value, t in sorted(self.thresholds.items()):
            if value:
                out = F.when(lang == value, F.lit(t)).otherwise(out)
        return out


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), learn: Column | None = None) -> Model:
    """Train on all labelled documents: ``labels`` (doc_id, toxic), those where ``learn`` holds.

    Texts are read once and kept as hashes of their words, dealt to shards by hash.
    One network learns all rows, and for each fold another all but the fold's. They
    start on the first shard; then, in rounds, every shard goes on from the common
    network, and the changes are averaged, piece by piece, by a shuffle. The driver
    holds one network at a time, whose size ``HASH_SPACE`` bounds, and which networks
    have a hash; the others' starts wait in a written table. A word has a vector if ``least_documents`` of the rows that its network
    learns from have it.

    Thresholds, a common one and one for each language with at least
    ``LEAST_TO_CALIBRATE`` toxic rows, come from scores of all rows, to four decimals,
    each row's by the network that has not seen its fold; the driver gets the number of
    rows of each score.

    Rows with a null label or id are left out; an id with several labels counts as
    toxic. Without toxic or without clean rows every text scores their share.
    """
    s, spark = settings, docs.sparkSession
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where("toxic in (0, 1)")
    if learn is not None:
        known = known.where(learn)
    known = stored(known, "toxicity-labels")
    if known.count() <= BROADCAST_MAX_LABELS:
        known = F.broadcast(known)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), lang.alias("lang")).join(known, "doc_id")
    rows = rows.select(F.xxhash64("doc_id", "text").alias("key"), "text", "lang", "toxic")
    rows = stored(rows.mapInArrow(_hashed, "key long, lang string, toxic int, words binary"), "toxicity-words")
    counts = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = counts.get(1, 0), counts.get(0, 0)
    if not toxic or not clean:
        net = Network.fresh(np.zeros(0, np.int64), s)
        net.out[:] = 0
        net.out_bias = 30.0 if toxic else -30.0
        return Model(net.saved(), {})
    shards = max(-(-toxic // s.max_toxic), -(-clean // s.max_clean))
    dealt = rows.select(
        "*", F.pmod(F.xxhash64("key", F.lit(s.seed)), F.lit(shards)).cast("int").alias("shard"), F.pmod(F.xxhash64("key", F.lit(s.seed + 1)), F.lit(s.folds)).cast("int").alias("fold")
    )
    by_shard = dealt.repartition(2 * shards, "shard").persist(StorageLevel.DISK_ONLY)
    hashes, nets = _hashes(dealt, s)
    started = stored(_started(dealt, s, hashes, nets), "toxicity-started")
    held = []
    for k in range(s.folds + 1):
        blob = _trained(by_shard, started, s, k, hashes, nets, s.rounds if shards > 1 else 0)
        if k < s.folds:
            held += _held_scores(dealt.where(F.col("fold") == k), blob)
    columns = [np.array([r[c] for r in held], t) for c, t in (("score", float), ("toxic", float), ("lang", str), ("n", float))]
    by_shard.unpersist()
    discard(rows, started)
    return Model(blob, calibrated(*columns))


def _hashes(dealt: DataFrame, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The hashes that any network has a vector for, ascending, and which networks do, a bit each; the last is that of all rows."""
    one = dealt.select("fold", "words").mapInArrow(_document_counts(s.folds), "fold int, hash int, n long")
    seen = one.groupBy("hash").agg(F.sum("n").alias("all"), *[F.sum(F.when(F.col("fold") == f, F.col("n")).otherwise(0)).alias(f"n{f}") for f in range(s.folds)])
    enough = [F.when(F.col("all") - (F.col(f"n{f}") if f < s.folds else 0) >= s.least_documents, 1 << f).otherwise(0) for f in range(s.folds + 1)]
    seen = seen.where(F.col("all") >= s.least_documents).select("hash", sum(enough).alias("nets")).orderBy("hash").toArrow()
    return seen["hash"].to_numpy().astype(np.int64), seen["nets"].to_numpy()


def _started(dealt: DataFrame, s: Settings, hashes: np.ndarray, nets: np.ndarray) -> DataFrame:
    """What of each network, by its fold's number, the first shard changes; ``s.folds`` is the network of all rows."""
    shipped = dealt.sparkSession.sparkContext.broadcast((hashes, nets))
    copies = dealt.where("shard = 0").withColumn("net", F.explode(F.sequence(F.lit(0), F.lit(s.folds))))
    # one task a network, however small the shard
    return copies.repartition(4 * (s.folds + 1), "net").groupBy("net").applyInArrow(lambda t: _first_shard(t, s, *shipped.value), CHANGES)


def _trained(by_shard: DataFrame, started: DataFrame, s: Settings, k: int, hashes: np.ndarray, nets: np.ndarray, rounds: int) -> bytes:
    """Network ``k``: from its start through ``rounds`` over all shards."""
    net = Network.fresh(_kept(hashes, nets, k), s)
    state = (net, state_of(net))
    _apply(state, started.where(F.col("net") == k).toArrow(), values=True)
    for turn in range(rounds):
        shipped = by_shard.sparkSession.sparkContext.broadcast(state)
        found = by_shard.groupBy("shard").applyInArrow(_round(shipped, s, k, turn), CHANGES)
        _apply(state, found.groupBy("net", "piece").applyInArrow(_averaged, CHANGES).toArrow())
        shipped.destroy()
    return net.saved()


def _round(shipped: Broadcast, s: Settings, k: int, turn: int):
    return lambda table: _changes(table, s, k, shipped.value, turn)


def _held_scores(rows: DataFrame, blob: bytes) -> list:
    """The number of rows of each (score, lang, toxic), scores to four decimals, by a network that has not seen them."""
    shipped = rows.sparkSession.sparkContext.broadcast(blob)
    scored = rows.select("words", "lang", "toxic").mapInArrow(_fold_scores(shipped), "score double, lang string, toxic int")
    held = scored.groupBy(F.round("score", 4).alias("score"), F.coalesce("lang", F.lit("")).alias("lang"), "toxic").agg(F.count(F.lit(1)).alias("n")).collect()
    shipped.destroy()
    return held


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with ``out_col``, read from the whole text alone; null and empty texts have one too."""
    shipped = docs.sparkSession.sparkContext.broadcast(model.blob)

    def run(batches):
        state, key = worker_state("toxicity"), ("toxicity", hash(shipped.value))
        if key not in state:
            state[key] = (Network.loaded(shipped.value), {})
        net, known = state[key]
        for batch in batches:
            for first, texts in slices(batch.column(batch.schema.get_field_index(text_col))):
                words = [words_of(t) for t in texts]
                if len(known) > 300_000:
                    known.clear()
                new = list({w for ws in words for w in ws if w not in known})
                known.update(zip(new, net.rows(np.array([word_hash(w) for w in new], np.int64)).tolist(), strict=True))
                rows = [np.fromiter(map(known.__getitem__, ws), np.int64, len(ws)) for ws in words]
                scores = np.empty(len(rows))
                size = 0
                begin = 0
                for i, r in enumerate(rows):
                    size += len(r) + 1
                    if size > WORDS_AT_ONCE or i == len(rows) - 1:
                        scores[begin : i + 1] = sigmoid(net.logits(rows[begin : i + 1]))
                        begin, size = i + 1, 0
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores)], names=[*part.schema.names, out_col])

    schema = T.StructType([*docs.schema.fields, T.StructField(out_col, T.DoubleType())])
    return docs.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
