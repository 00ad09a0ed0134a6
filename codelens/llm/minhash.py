"""Near-duplicate documents by a multi-index Hamming join of b-bit minhash signatures."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelens.llm.common import connected_components, discard, stored, worker_state
from codelens.llm.tokens import distinct_strings, slices


@dataclass(frozen=True)
class Settings:
    """Signatures of ``length`` 16-bit values, cut into ``chunks``.

    Two signatures that differ in at most ``2 * chunks - 1`` values have a chunk
    with at most one difference: with 64 values and 12 chunks all pairs up to
    distance 23 are found, and most beyond. A set similarity of 0.8 gives a
    distance of 12.8 on average; one in about 1,000 such pairs is above 23, and
    fewer than one in a million has no chunk in common. Pairs up to ``accept``
    are candidates. ``fine`` further values, of 8 bits, sharpen the estimate
    where whole groups are compared: there a pair is compared in full if it
    differs in at most ``accept_all`` of all values, six standard deviations (of 6.4)
    above the mean of 51 at a similarity of 0.8. ``rounds``: see ``near_duplicates``.
    """

    words: int = 5
    percent: int = 80
    length: int = 64
    chunks: int = 12
    accept: int = 30
    fine: int = 192
    accept_all: int = 90
    rounds: int = 3
    block: int = 512
    cell_rows: int = 20_000
    seed: int = 7


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct hashes of every run of ``words`` words; a shorter text is one run.

    Words are what stands between the white space characters 9 to 13 and 32, A-Z
    lower-cased; Arrow finds the distinct ones, and each of them is hashed once.
    """
    column = pc.ascii_trim_whitespace(pc.ascii_lower(pa.array(texts, pa.large_binary()).cast(pa.large_string())))
    split = pc.ascii_split_whitespace(column)
    sizes = np.where(pc.binary_length(column).to_numpy() > 0, pc.list_value_length(split).to_numpy(), 0).astype(np.int64)
    coded = split.flatten().filter(pc.greater(pc.binary_length(split.flatten()), 0)).dictionary_encode()
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in distinct_strings(coded.dictionary)], np.uint64)
    flat = hashes[coded.indices.to_numpy()] if len(hashes) else hashes
    ends = np.cumsum(sizes)
    run = np.zeros(len(flat), np.uint64)
    for k in range(words):  # run[i] covers flat[i : i + words]; those across texts are not used
        part = flat[k:]
        run[: len(part)] = (run[: len(part)] ^ part) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
        run[: len(part)] ^= run[: len(part)] >> np.uint64(29)
    out = []
    for begin, end in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
        n = end - begin
        if n >= words:
            out.append(np.unique(run[begin : end - words + 1]))
        elif n:
            out.append(np.array([xxhash.xxh3_64_intdigest(flat[begin:end].tobytes(), seed=n)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], s: Settings) -> np.ndarray:
    """16 bits of the smallest of each of ``length + fine`` random orders of every set (rows of zeros for empty sets)."""
    rng = np.random.default_rng(s.seed)
    length = s.length + s.fine
    factors = rng.integers(0, 1 << 63, length, np.uint64) << np.uint64(1) | np.uint64(1)
    masks = rng.integers(0, 1 << 63, length, np.uint64)
    out = np.zeros((len(sets), length), np.uint16)
    some = [i for i, x in enumerate(sets) if len(x)]
    if some:
        flat = np.concatenate([sets[i] for i in some])
        begin = np.cumsum([0] + [len(sets[i]) for i in some[:-1]])
        order, high = np.empty_like(flat), np.empty_like(flat)
        for k in range(length):
            np.bitwise_xor(flat, masks[k], out=order)
            order *= factors[k]
            np.right_shift(order, np.uint64(32), out=high)
            order ^= high
            least = np.minimum.reduceat(order, begin)
            out[some, k] = (least * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48)
    return out


def index_keys(sigs: np.ndarray, s: Settings) -> np.ndarray:
    """A key for every chunk and every value of it left out: equal if the chunks differ there at most."""
    rng = np.random.default_rng(s.seed + 1)
    factors = rng.integers(0, 1 << 63, s.length, np.uint64) << np.uint64(1) | np.uint64(1)
    marks = rng.integers(0, 1 << 63, s.length, np.uint64)
    weighted = (sigs.astype(np.uint64) + np.uint64(1)) * factors
    keys = np.empty(sigs.shape, np.uint64)
    for places in np.array_split(np.arange(s.length), s.chunks):
        keys[:, places] = weighted[:, places].sum(1, dtype=np.uint64)[:, None] - weighted[:, places]
    keys += marks
    keys ^= keys >> np.uint64(31)
    keys *= np.uint64(0x9E3779B97F4A7C15)
    keys ^= keys >> np.uint64(29)
    return keys


def _signed(docs: DataFrame, s: Settings, id_col: str, text_col: str) -> DataFrame:
    """id, n (size of the set), lo and hi (sums of hashes that tell equal sets), sig, fine."""

    def run(batches):
        worker_state("minhash")  # what another operator left in this worker goes
        for batch in batches:
            for first, texts in slices(batch.column(1)):
                sets = shingle_sets(texts, s.words)
                sigs = signatures(sets, s)
                n = np.array([len(x) for x in sets], np.int64)
                lo = np.array([int((x * np.uint64(0xC2B2AE3D27D4EB4F)).sum(dtype=np.uint64)) for x in sets], np.uint64)
                hi = np.array([int(((x ^ (x >> np.uint64(33))) * (x | np.uint64(1))).sum(dtype=np.uint64)) for x in sets], np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(texts)), pa.array(n), pa.array(lo.view(np.int64)), pa.array(hi.view(np.int64)),
                        pa.array([row.tobytes() for row in sigs[:, : s.length]], pa.binary()),
                        pa.array([row.tobytes() for row in sigs[:, s.length :].astype(np.uint8)], pa.binary()),
                    ],
                    names=["id", "n", "lo", "hi", "sig", "fine"],
                )

    source = docs.select(F.col(id_col).cast("long").alias("id"), text_col)
    return stored(source.mapInArrow(run, "id long, n long, lo long, hi long, sig binary, fine binary"), "minhash-signed")


def _keyed(classes: DataFrame, s: Settings) -> DataFrame:
    def run(batches):
        worker_state("minhash")  # what another operator left in this worker goes
        for batch in batches:
            sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, s.length)
            reps = batch.column("rep").to_numpy()
            for first in range(0, len(sigs), 2048):
                keys = index_keys(sigs[first : first + 2048], s).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel()), pa.array(np.repeat(reps[first : first + 2048], s.length))], names=["key", "rep"]
                )

    return classes.select("rep", "sig").mapInArrow(run, "key long, rep long")


def _confirmed(pairs: DataFrame, docs: DataFrame, s: Settings, id_col: str, text_col: str) -> DataFrame:
    """A written table of those of ``pairs`` (a, b) whose full sets are similar enough."""
    pairs = stored(pairs, "minhash-pairs")
    wanted = stored(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "minhash-wanted")

    def run(batches):
        worker_state("minhash")  # what another operator left in this worker goes
        for batch in batches:
            for first, texts in slices(batch.column(1)):
                sets = shingle_sets(texts, s.words)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))],
                    names=["id", "shingles"],
                )

    source = docs.select(F.col(id_col).cast("long").alias("id"), text_col).join(wanted, "id", "left_semi")
    sets = stored(source.mapInArrow(run, "id long, shingles array<long>"), "minhash-sets")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b"
    )
    common = F.size(F.array_intersect("x", "y")).cast("long")
    sizes = F.size("x").cast("long") + F.size("y").cast("long")
    links = stored(both.where(100 * common >= s.percent * (sizes - common)).select("a", "b").distinct(), "minhash-links")
    discard(pairs, wanted, sets)
    return links


def _alike_in_size(s: Settings, x: str, y: str):
    return (F.col(x) * 100 >= F.col(y) * s.percent) & (F.col(y) * 100 >= F.col(x) * s.percent)


def _open_pairs(members: DataFrame, details: DataFrame, s: Settings, turn: int | None) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs within a bucket that may be similar and are in different components so far, and the written tables they are read from.

    ``members``: key, rep, label; ``details``: rep, n, sig, fine. Within a bucket, the
    members outside the most frequent label meet all others; both are cut into blocks,
    so that a cell of a large bucket is one block of the former against one of the
    latter and no task holds a bucket. Buckets and cells are made of numbers alone;
    signatures join the finished cells. A cell compares them in numpy; cells are
    grouped so that a group has some ``cell_rows`` rows. With ``turn``, every member
    returns the nearest of the others (of a random half of them after turn 0), and
    of these its nearest over all cells is kept: one pair per member. Without it,
    all pairs near enough come back.
    """
    by_label = members.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n_label"))
    buckets = by_label.groupBy("key").agg(
        F.max_by("label", F.struct("n_label", "label")).alias("main"),
        F.sum("n_label").alias("n_all"),
        F.max("n_label").alias("n_main"),
    ).where("n_main < n_all")
    buckets = stored(
        buckets.select(
            "key", "main",
            F.ceil((F.col("n_all") - F.col("n_main")) / s.block).cast("int").alias("minor_blocks"),
            F.ceil(F.col("n_all") / s.block).cast("int").alias("all_blocks"),
        ),
        "minhash-buckets",
    )
    rows = members.join(buckets, "key")
    block = F.xxhash64("rep", F.lit(s.seed))
    minor = rows.where("label <> main").select(
        "key", "rep", "label", F.lit(True).alias("minor"),
        F.pmod(block, "minor_blocks").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("all_blocks") - 1)).alias("j"),
    )
    everyone = rows.select(
        "key", "rep", "label", F.lit(False).alias("minor"),
        F.explode(F.sequence(F.lit(0), F.col("minor_blocks") - 1)).alias("i"), F.pmod(block, "all_blocks").cast("int").alias("j"),
    )
    cells = stored(minor.union(everyone).select("rep", "label", "minor", F.xxhash64("key", "i", "j").alias("cell")), "minhash-cells")
    groups = max(1, cells.count() // s.cell_rows)
    grouped = cells.withColumn("part", F.pmod(F.xxhash64("cell"), F.lit(groups))).join(details, "rep")

    def run(key, table):
        cell = table["cell"].to_numpy()
        order = np.lexsort((table["minor"].to_numpy(), cell))
        cell = cell[order]
        minor = table["minor"].to_numpy()[order]
        rep, n, label = (table[c].to_numpy()[order] for c in ("rep", "n", "label"))
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint16).reshape(-1, s.length)[order]
        fine = np.frombuffer(b"".join(table["fine"].to_pylist()), np.uint8).reshape(len(cell), -1)[order]
        eligible = np.ones(len(rep), bool)
        if turn:
            eligible = (rep.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * turn) >> np.uint64(40)) & np.uint64(1) == 0
        edges = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])).tolist() + [len(cell)]
        found: list[np.ndarray] = []
        for begin, end in zip(edges[:-1], edges[1:], strict=True):
            middle = begin + int(np.searchsorted(minor[begin:end], True))
            for m in range(middle, end):
                x = np.arange(begin, middle)
                x = x[eligible[x] & (label[x] != label[m]) & (n[x] * 100 >= n[m] * s.percent) & (n[m] * 100 >= n[x] * s.percent)]
                if not len(x):
                    continue
                apart = (sig[x] != sig[m]).sum(1)
                x, apart = x[apart <= s.accept], apart[apart <= s.accept]
                if not len(x):
                    continue
                apart = apart + (fine[x] != fine[m]).sum(1)
                x, apart = x[apart <= s.accept_all], apart[apart <= s.accept_all]
                if turn is not None and len(x):
                    best = np.lexsort((rep[x], apart))[:1]
                    x, apart = x[best], apart[best]
                if len(x):
                    found.append(np.stack([np.full(len(x), rep[m]), rep[x], apart], 1))
        pairs = np.concatenate(found).astype(np.int64) if found else np.zeros((0, 3), np.int64)
        if turn is None:
            pairs[:, :2] = np.sort(pairs[:, :2], 1)
        pairs = np.unique(pairs, axis=0)
        if turn is not None:
            pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 2], pairs[:, 0]))]
            pairs = pairs[np.append(True, pairs[1:, 0] != pairs[:-1, 0])[: len(pairs)]]
        return pa.table({c: pa.array(pairs[:, i], pa.int64()) for i, c in enumerate(("a", "b", "apart"))})

    out = grouped.groupBy("part").applyInArrow(run, "a long, b long, apart long")
    if turn is None:
        return out.select("a", "b").distinct(), [buckets, cells]
    return out.groupBy("a").agg(F.min_by("b", F.struct("apart", "b")).alias("b")), [buckets, cells]


def _without_repeated(members: DataFrame) -> DataFrame:
    """A written table of ``members`` (key, rep, leader) in which buckets of the same members are one; ``times`` says how many.

    Similar classes share most of their keys, so that the same few classes meet in
    dozens of buckets. Sets of members are told apart by their size and 128 bits.
    """
    of_bucket = members.groupBy("key").agg(
        F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit("second"))).alias("y")
    )
    one = of_bucket.groupBy("size", "x", "y").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("times")).select("key", "times")
    return stored(members.join(one, "key"), "minhash-members")


def near_duplicates(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id reachable over links), kept (id = component_id).

    1. Sets of word runs become signatures; rows with equal sets are one class,
       named by its smallest id (combined before the shuffle).
    2. Every class enters the index under ``length`` keys: a chunk with one value
       left out, for all values of all chunks. Buckets of the same classes count as one.
    3. A class is first compared, in full, with one other: the smallest id of one
       of its buckets, the one it shares most buckets with. Components of these
       links join the members of large groups of copies without any pairs.
    4. ``rounds`` times, every class in a bucket with several components is compared
       with the nearest class of another component, by signature: one pair per class.
    5. All pairs in a bucket that are still in different components, whose sizes
       allow the similarity and whose signatures are near enough are compared in
       full. Nothing else can join two components. By then the members of a large
       group are one component, and only what is close to it without belonging
       to it is left to compare.

    No step holds a bucket, a group or a component in one task or on the driver.

    Null and empty texts have empty sets and link with nothing; a text with fewer
    words than a run is one run. A null id is a row of its own (component null,
    kept). Rows that repeat an id are linked through it. Extra columns are
    ignored. An empty table gives no rows.
    """
    s = settings
    signed = _signed(docs, s, id_col, text_col)
    known = signed.where("n > 0 and id is not null")
    classes = known.groupBy("lo", "hi").agg(F.min("id").alias("rep"), F.min("n").alias("n"), F.first("sig").alias("sig"), F.first("fine").alias("fine"))
    classes = stored(classes, "minhash-classes")
    keyed = _keyed(classes, s)
    shared = stored(
        keyed.groupBy("key").agg(F.min("rep").alias("leader"), F.max("rep").alias("last")).where("leader < last").select("key", "leader"),
        "minhash-shared",
    )
    repeated = stored(keyed.join(shared, "key"), "minhash-repeated")
    members = _without_repeated(repeated)
    discard(shared, repeated)
    shares = members.where("rep <> leader").groupBy("rep", "leader").agg(F.sum("times").alias("k"))
    nearest = shares.groupBy("rep").agg(F.max_by("leader", F.struct("k", -F.col("leader"))).alias("leader"))
    sized = classes.groupBy("rep").agg(F.max("n").alias("n"))
    sizes = stored(sized, "minhash-sizes")
    star = (
        nearest.join(sizes, "rep").join(sizes.select(F.col("rep").alias("leader"), F.col("n").alias("n_leader")), "leader")
        .where(_alike_in_size(s, "n", "n_leader")).select(F.col("rep").alias("a"), F.col("leader").alias("b"))
    )
    links = _confirmed(star, docs, s, id_col, text_col)
    components = connected_components(links)
    details = classes.select("rep", "n", "sig", "fine")
    for turn in (*range(s.rounds), None):
        label = F.coalesce("component", "rep")
        labelled = members.select("key", "rep").join(components.withColumnRenamed("node", "rep"), "rep", "left")
        labelled = labelled.select("key", "rep", label.alias("label"))
        opened = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
        unsettled = stored(labelled.join(opened, "key"), "minhash-unsettled")
        discard(members)
        members = unsettled  # a settled bucket stays settled
        pairs, used = _open_pairs(unsettled, details, s, turn)
        more = _confirmed(pairs, docs, s, id_col, text_col)
        discard(*used)
        if turn is not None and more.isEmpty():
            continue
        links = links.union(more)
        components = connected_components(links)
    named = classes.select("lo", "hi", "rep").join(components.withColumnRenamed("node", "rep"), "rep", "left")
    named = stored(named.select("lo", "hi", F.coalesce("component", "rep").alias("of_class")), "minhash-named")
    discard(members, sizes, classes)
    out = signed.select("id", "n", "lo", "hi").join(named, ["lo", "hi"], "left")
    component = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("of_class")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")
    )


def oracle_sql(words: int, percent: int) -> str:
    """All pairs that share a run of words, counted in full; components by repeated reach."""
    return f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {words} THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - {words - 2}), lambda i: array_to_string(words[i:i + {words - 1}], ' '))) END AS shingles
  FROM w),
n AS (SELECT doc_id, len(shingles)::BIGINT AS n_shingles FROM s),
e AS (SELECT doc_id, unnest(shingles) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (
  SELECT a, b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id
  WHERE 100 * common >= {percent} * (x.n_shingles + y.n_shingles - common)),
g AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, g.b FROM r JOIN g ON r.b = g.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c USING (doc_id)
"""
