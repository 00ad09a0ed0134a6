"""Language-model scoring: masked pseudo-likelihood of a bidirectional window network, trained in numpy."""

from __future__ import annotations

import heapq
import io
import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelens.llm.common import stored, worker_state
from codelens.llm.tokens import slices


@dataclass(frozen=True)
class Settings:
    """``classes`` x ``per_class`` words have rows of their own; ``masked`` is the share of places hidden at a time, in ``rounds`` rounds at least."""

    classes: int = 64
    per_class: int = 64
    others: int = 256
    reach: int = 2
    size: int = 16
    hidden: int = 32
    masked: float = 0.17
    rounds: int = 3
    batch: int = 4096
    rate: float = 0.6
    seed: int = 3

    @property
    def words(self) -> int:
        return self.classes * self.per_class

    @property
    def parts(self) -> int:
        """Every place is in one of so many parts, each masked in a round of its own."""
        return max(1, math.ceil(1 / self.masked))


MARKS = tuple(bytes([c]) for c in b".,;:!?()|\"")


def words_of(text: bytes) -> list[bytes]:
    """What stands between ASCII white space, A-Z lower-cased; the marks above are words of their own."""
    text = text.lower()
    for mark in MARKS:
        if mark in text:
            text = text.replace(mark, b" " + mark + b" ")
    return text.split()


class Vocabulary(dict):
    """Ids of words: their place for the listed ones, by hash among ``others`` for the rest; remembers what it met."""

    def __init__(self, listed: list[bytes], s: Settings):
        super().__init__()
        self.listed, self.first_other, self.others = {w: i for i, w in enumerate(listed)}, s.words - s.others, s.others

    def __missing__(self, word: bytes) -> int:
        i = self.listed.get(word)
        self[word] = i = self.first_other + zlib.crc32(word) % self.others if i is None else i
        return i

    def ids(self, words: list[bytes]) -> np.ndarray:
        if len(self) > 500_000:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


class Network:
    """Vectors of the ``reach`` words on either side -> tanh layer -> class -> word within the class."""

    def __init__(self, s: Settings, v: dict[str, np.ndarray], order: np.ndarray):
        self.s, self.v = s, v
        self.order = order  # word id -> place: class * per_class + place within the class

    @staticmethod
    def fresh(s: Settings, order: np.ndarray) -> Network:
        rng = np.random.default_rng(s.seed)

        def r(*shape, scale):
            return rng.normal(0, scale, shape).astype(np.float32)

        width = 2 * s.reach * s.size
        return Network(
            s,
            {
                "embedding": r(s.words + 1, s.size, scale=0.1),
                "w": r(width, s.hidden, scale=width**-0.5),
                "b": np.zeros(s.hidden, np.float32),
                "wc": r(s.hidden, s.classes, scale=0.05),
                "bc": np.zeros(s.classes, np.float32),
                "ww": r(s.classes, s.hidden, s.per_class, scale=0.05),
                "bw": np.zeros((s.classes, s.per_class), np.float32),
            },
            order,
        )

    def contexts(self, ids: np.ndarray, begin: np.ndarray, where: np.ndarray) -> np.ndarray:
        """Ids around the places ``where``; row ``words`` of the embedding stands outside the text."""
        s = self.s
        padded = np.full(len(ids) + len(begin) * s.reach + s.reach, s.words, np.uint16)
        text = np.repeat(np.arange(1, len(begin) + 1), np.diff(begin, append=len(ids)))
        padded[np.arange(len(ids)) + text * s.reach] = ids
        at = where + text[where] * s.reach if len(where) else where
        around = [k for k in range(-s.reach, s.reach + 1) if k]
        return np.stack([padded.take(at + k) for k in around], axis=1) if len(where) else np.zeros((0, 2 * s.reach), np.uint16)

    def bounded(self) -> bool:
        """Whether no exponential of a logit can overflow: |h| is at most 1, so sums of absolute weights bound the logits."""
        v = self.v
        return max((abs(v["wc"]).sum(0) + abs(v["bc"])).max(), (abs(v["ww"]).sum(1) + abs(v["bw"])).max()) < 80

    def log_probabilities(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """log P(target | both sides), a softmax over classes times one over the words of the class."""
        s, v = self.s, self.v
        place = self.order.take(target).astype(np.uint16)  # 16 bits are sorted by radix
        by_class = np.argsort(place, kind="stable")
        context, place = context.take(by_class, axis=0), place.take(by_class).astype(np.int64)
        found = np.empty(len(target), np.float32)
        safe = self.bounded()
        for first in range(0, len(target), 4096):
            t = place[first : first + 4096]
            n = len(t)
            h = v["embedding"].take(context[first : first + n].ravel(), axis=0).reshape(n, -1) @ v["w"]
            h += v["b"]
            np.tanh(h, out=h)
            k, j = t // s.per_class, t % s.per_class
            score = _log_softmax_at(h @ v["wc"] + v["bc"], k, safe)
            edges = np.searchsorted(k, np.arange(s.classes + 1))
            for q in range(int(k[0]), int(k[-1]) + 1):  # sorted: the rows of a class are next to each other
                a, b = edges[q], edges[q + 1]
                if a < b:
                    score[a:b] += _log_softmax_at(h[a:b] @ v["ww"][q] + v["bw"][q], j[a:b], safe)
            found[first : first + n] = score
        out = np.empty(len(target))
        out[by_class] = found
        return out

    def train(self, context: np.ndarray, target: np.ndarray, rng: np.random.Generator, sums: dict[str, np.ndarray]) -> None:
        """One pass of Adagrad steps over examples in random order; ``sums`` go on from call to call."""
        s, v = self.s, self.v
        context, place = context.astype(np.uint16), self.order.take(target).astype(np.uint16)  # 16 bits are sorted by radix
        everything = rng.permutation(len(target))
        for first in range(0, len(everything), s.batch):
            some = everything[first : first + s.batch]
            some = some[np.argsort(place[some], kind="stable")]
            ids, n = context.take(some, axis=0).ravel(), len(some)
            k, j = np.divmod(place[some].astype(np.int64), s.per_class)
            safe = self.bounded()
            x = v["embedding"].take(ids, axis=0).reshape(n, -1)
            h = x @ v["w"]
            h += v["b"]
            np.tanh(h, out=h)
            g_class = _softmax(h @ v["wc"] + v["bc"], safe)
            g_class[np.arange(n), k] -= 1
            g_h = g_class @ v["wc"].T
            g_ww, g_bw = np.zeros_like(v["ww"]), np.zeros_like(v["bw"])
            edges = np.searchsorted(k, np.arange(s.classes + 1)).tolist()
            for q in range(s.classes):  # sorted: the rows of a class are next to each other
                a, b = edges[q], edges[q + 1]
                if a == b:
                    continue
                g = _softmax(h[a:b] @ v["ww"][q] + v["bw"][q], safe)
                g[np.arange(b - a), j[a:b]] -= 1
                g_h[a:b] += g @ v["ww"][q].T
                np.matmul(h[a:b].T, g, out=g_ww[q])
                g_bw[q] = g.sum(0)
            g_z = g_h * (1 - h * h)
            g_x = (g_z @ v["w"].T).reshape(-1, s.size)
            by_id = np.argsort(ids, kind="stable")
            row, edge = np.unique(ids.take(by_id), return_index=True)
            g_x = np.add.reduceat(g_x.take(by_id, axis=0), edge, axis=0) / np.float32(n)
            sums["embedding"][row] += g_x * g_x
            v["embedding"][row] -= s.rate * g_x / np.sqrt(sums["embedding"][row])
            for name, g in (("ww", g_ww), ("bw", g_bw), ("w", x.T @ g_z), ("b", g_z.sum(0)), ("wc", h.T @ g_class), ("bc", g_class.sum(0))):
                _step(v[name], sums[name], g / np.float32(n), s.rate)

    def saved(self) -> bytes:
        buffer = io.BytesIO()
        np.savez(buffer, order=self.order, **self.v)
        return buffer.getvalue()

    @staticmethod
    def loaded(blob: bytes, s: Settings) -> Network:
        with np.load(io.BytesIO(blob)) as z:
            return Network(s, {k: z[k] for k in z.files if k != "order"}, z["order"])


def _step(value: np.ndarray, total: np.ndarray, g: np.ndarray, rate: float) -> None:
    """Adagrad, in place."""
    total += g * g
    value -= rate * g / np.sqrt(total)


def _softmax(x: np.ndarray, safe: bool) -> np.ndarray:
    """Of each row; ``safe``: no exponential can overflow. Overwrites x."""
    if not safe:
        x -= x.max(1, keepdims=True)
    np.exp(x, out=x)
    x /= (x @ np.ones(x.shape[1], x.dtype))[:, None]
    return x


def _log_softmax_at(x: np.ndarray, at: np.ndarray, safe: bool) -> np.ndarray:
    """Of each row, at one place; ``safe``: no exponential can overflow. Overwrites x."""
    if not safe:
        x -= x.max(1)[:, None]
    chosen = x[np.arange(len(x)), at]
    return chosen - np.log(np.exp(x, out=x) @ np.ones(x.shape[1], x.dtype))


@dataclass(frozen=True)
class Words:
    """``listed``: words with ids of their own; ``order``: every id's place; ``totals``: tokens behind each of the shared ids; ``counts``: every word's."""

    listed: list[bytes]
    order: np.ndarray
    totals: np.ndarray
    counts: DataFrame


def vocabulary(docs: DataFrame, s: Settings, text_col: str = "text") -> Words:
    """The listed words by falling count (ties by bytes), every id's share of a class, and the table of all words' counts.

    Counts are over all words of all texts: each task adds up its own before the
    shuffle, Spark sums them. The driver gets the listed words and one sum per
    shared id, numbers that ``Settings`` fixes; the other words stay in the table.
    """
    counts = stored(
        docs.select(text_col).mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "lm-counts"
    )
    listed = counts.orderBy(F.col("n").desc(), "word").limit(s.words - s.others).collect()
    totals = np.zeros(s.others)
    for r in counts.groupBy(F.pmod(F.crc32("word"), F.lit(s.others)).alias("other")).agg(F.sum("n").alias("n")).collect():
        totals[r["other"]] = r["n"]
    for r in listed:
        totals[zlib.crc32(r["word"]) % s.others] -= r["n"]
    mass = np.full(s.words, 0.0)
    mass[: len(listed)] = [r["n"] for r in listed]
    mass[s.words - s.others :] = totals
    return Words([bytes(r["word"]) for r in listed], _classes(mass, s), totals, counts)


def _classes(mass: np.ndarray, s: Settings) -> np.ndarray:
    """Deal ids, heaviest first, to the class that is lightest and not full."""
    heap = [(0.0, c, 0) for c in range(s.classes)]
    order = np.zeros(s.words, np.int64)
    for i in np.argsort(-mass, kind="stable"):
        weight, c, n = heapq.heappop(heap)
        order[i] = c * s.per_class + n
        if n + 1 < s.per_class:
            heapq.heappush(heap, (weight + mass[i], c, n + 1))
    return order


def _count_words(batches):
    counts: Counter = Counter()

    def emptied():
        words, numbers = list(counts), list(counts.values())
        counts.clear()
        for i in range(0, len(words), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(words[i : i + 50_000], pa.binary()), pa.array(numbers[i : i + 50_000], pa.int64())], names=["word", "n"])

    for batch in batches:
        for _, texts in slices(batch.column(0)):
            for t in texts:
                counts.update(words_of(t))
            if len(counts) > 1_000_000:
                yield from emptied()
    yield from emptied()


def encoded(docs: DataFrame, words: Words, s: Settings, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written table of every row's other columns (``kept``), a row number, the words' ids (16 bits) and its words without an id of their own."""
    kept = [f.name for f in docs.schema.fields if f.name not in (text_col, "n_tokens", "log_likelihood", "mean_log_likelihood")]
    shipped = docs.sparkSession.sparkContext.broadcast(words.listed)

    def run(batches):
        vocab = Vocabulary(shipped.value, s)
        for batch in batches:
            for first, texts in slices(batch.column(2), 1 << 20):
                ids, rare = [], []
                for t in texts:
                    found = words_of(t)
                    ids.append(vocab.ids(found))
                    rare.append([found[i] for i in np.flatnonzero(ids[-1] >= vocab.first_other).tolist()])
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([x.astype("<u2").tobytes() for x in ids], pa.binary()), pa.array(rare, pa.list_(pa.binary()))],
                    names=["kept", "key", "ids", "rare"],
                )

    source = docs.select(F.struct(*kept).alias("kept"), F.xxhash64(id_col, text_col).alias("key"), text_col)
    schema = T.StructType([*source.schema.fields[:2], T.StructField("ids", T.BinaryType()), T.StructField("rare", T.ArrayType(T.BinaryType()))])
    return stored(source.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "lm-ids")


def _texts(keys: pa.Array, blobs: pa.Array, most: int = 1 << 20):
    """(first row, keys, ids of all texts, sizes) for runs of rows with about ``most`` bytes of ids."""
    for first, some in slices(blobs, most):
        yield first, keys.slice(first, len(some)), np.frombuffer(b"".join(some), "<u2").astype(np.int64), np.array([len(x) // 2 for x in some])


#: Examples that a task puts in random order, or scores, at once (memory only).
EXAMPLES = 1 << 18


def part_of(keys: np.ndarray, sizes: np.ndarray, s: Settings) -> np.ndarray:
    """The part of every place of texts with these keys and sizes, by a hash of key and place."""
    place = np.arange(int(sizes.sum()), dtype=np.uint64) - np.repeat(np.cumsum(sizes) - sizes, sizes).astype(np.uint64)
    z = np.repeat(keys.astype(np.uint64), sizes) + (place + np.uint64(s.seed)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) % np.uint64(s.parts)).astype(np.int64)


def examples(net: Network, keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray, r: int) -> np.ndarray:
    """The neighbours on both sides and the word of all places that round ``r`` masks, a row each."""
    where = np.flatnonzero(part_of(keys, sizes, net.s) == r % net.s.parts)
    return np.hstack([net.contexts(ids, np.cumsum(sizes) - sizes, where), ids[where][:, None].astype(np.uint16)])


def train(table: DataFrame, order: np.ndarray, s: Settings) -> Network:
    """Local steps in every task, averaged after each round.

    A seeded hash deals all places of all texts to parts of a share ``masked``
    each, and every round masks the next part, until all places have been learned
    from. In a round each task starts from the shared weights and makes Adagrad
    steps over its masked places, so many at a time; the weights come back
    weighted by examples, summed by Spark key by key, so that the driver gets
    one network, whatever the number of tasks.
    """
    spark = table.sparkSession
    net = Network.fresh(s, order)
    names = list(net.v)
    for r in range(max(s.rounds, s.parts)):
        now = spark.sparkContext.broadcast(net.saved())

        def steps(batches, now=now, r=r):
            local = Network.loaded(now.value, s)
            sums = {k: np.full_like(x, 1e-3) for k, x in local.v.items()}
            rng, waiting, learned = np.random.default_rng((s.seed, r)), [], 0

            def learn():
                data = np.concatenate(waiting)
                waiting.clear()
                local.train(data[:, :-1], data[:, -1], rng, sums)
                return len(data)

            for batch in batches:
                for _, keys, ids, sizes in _texts(batch.column(0), batch.column(1)):
                    if len(ids):
                        waiting.append(examples(local, keys.to_numpy(), ids, sizes, r))
                    if sum(map(len, waiting)) >= EXAMPLES:
                        learned += learn()
            if waiting:
                learned += learn()
            if not learned:
                return
            weight = float(learned)
            for i, name in enumerate(names):
                flat = local.v[name].ravel() * np.float32(weight)
                for at in range(0, len(flat), 16384):
                    yield pa.RecordBatch.from_pydict(
                        {"name": pa.array([i], pa.int32()), "at": pa.array([at], pa.int64()), "weight": pa.array([weight]), "values": pa.array([flat[at : at + 16384].astype("<f4").tobytes()], pa.binary())}
                    )

        local = table.select("key", "ids").mapInArrow(steps, "name int, at long, weight double, values binary")
        summed = local.groupBy("name", "at").applyInArrow(_mean_of_weights, "name int, at long, values binary").orderBy("name", "at").collect()
        if summed:
            for i, name in enumerate(names):
                flat = np.frombuffer(b"".join(bytes(x["values"]) for x in summed if x["name"] == i), "<f4")
                net.v[name] = flat.reshape(net.v[name].shape).copy()
        now.unpersist()
    return net


def _mean_of_weights(key, group):
    weights = group["weight"].to_numpy()
    total = sum(np.frombuffer(b, "<f4").astype(np.float64) for b in group["values"].to_pylist())
    mean = (total / weights.sum()).astype("<f4").tobytes()
    return pa.table({"name": pa.array([key[0].as_py()], pa.int32()), "at": pa.array([key[1].as_py()], pa.int64()), "values": pa.array([mean], pa.binary())})


def text_sums(net: Network, own: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of every text, the sum of its words' log-probabilities and of ``own`` by id; a long text goes piece by piece."""
    reach, sums = net.s.reach, np.zeros(len(sizes))
    text, begin = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
    for a in range(0, len(ids), EXAMPLES):
        some = ids[a : a + EXAMPLES]
        low = max(0, a - reach)
        around = ids[low : a + len(some) + reach]
        context = net.contexts(around, np.clip(begin - low, 0, len(around)), np.arange(len(some)) + (a - low))
        each = net.log_probabilities(context, some) + own[some]
        sums += np.bincount(text[a : a + len(some)], weights=each, minlength=len(sums))
    return sums


def score(table: DataFrame, net: Network, words: Words) -> DataFrame:
    """``kept`` columns with n_tokens, log_likelihood (sum over all words) and mean_log_likelihood (null without words).

    A shared id's probability is divided among its words by their counts: the
    network and the shared ids' totals are applied in the tasks, the words' own
    counts are joined from the counted table.
    """
    s = net.s
    spark = table.sparkSession
    with np.errstate(divide="ignore"):
        own = np.concatenate((np.zeros(s.words - s.others), -np.log(words.totals)))
    shipped = spark.sparkContext.broadcast((net.saved(), own))

    def run(batches):
        state, key = worker_state("lm"), ("lm", hash(shipped.value[0]))
        if key not in state:
            state[key] = Network.loaded(shipped.value[0], s)
        model, own = state[key], shipped.value[1]
        for batch in batches:
            for first, _, ids, sizes in _texts(batch.column(1), batch.column(2)):
                sums = text_sums(model, own, ids, sizes)
                part = batch.slice(first, len(sizes))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(sums)], names=["kept", "row", "n_tokens", "shared"]
                )

    schema = T.StructType([table.schema["kept"], table.schema["row"], T.StructField("n_tokens", T.LongType()), T.StructField("shared", T.DoubleType())])
    shared = table.select("kept", "row", "ids").mapInArrow(run, schema)
    rare = table.select("row", F.explode("rare").alias("word")).join(words.counts, "word")
    shares = rare.groupBy("row").agg(F.sum(F.log("n")).alias("share"))
    total = F.col("shared") + F.coalesce("share", F.lit(0.0))
    return shared.join(shares, "row", "left").select(
        "kept.*", "n_tokens", total.alias("log_likelihood"), F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias("mean_log_likelihood")
    )


def pseudo_likelihood(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every document by the words' log-probabilities given both sides.

    The network is trained on the documents themselves: words counted over all
    texts, every place of every text learned from. Every counted word has a probability of
    its own: the listed ones from the network, the others their id's, divided
    by their counts. ``docs``' columns but the text pass through.

    Null and empty texts have no words: sum 0, mean null. A text of any length is
    scored whole (its words, not its document, are batched). Repeated rows are
    counted, learned from and scored each. An empty table gives no rows. Scores
    depend on how rows are dealt to tasks, as local steps do; on the same files
    and settings they repeat.
    """
    words = vocabulary(docs, settings, text_col)
    table = encoded(docs, words, settings, id_col, text_col)
    return score(table, train(table, words.order, settings), words)
