"""Importance resampling towards a target distribution: hashed n-grams, their gains, and a seeded draw without replacement."""

from __future__ import annotations

import itertools
import operator
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelens.llm.common import crc32_sql, shuffle_width, stored

#: Bytes between words: all below "0", between "9" and "a", and from "{" to 0x7F, once A-Z are lower-cased.
_SPACED = bytes(32 if b < 0x30 or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256))
#: From every word on, the run of up to three words; overlapped matches begin at every word.
_RUNS = regex.compile(rb"(?<![^ ])[^ ]+(?: [^ ]+){0,2}(?![^ ])")
_SPAN = operator.methodcaller("span")
#: Matches and bytes of text that are handled at once (memory only).
_MATCHES, _SLICE_BYTES = 1 << 19, 4 << 20
#: Words up to this many bytes go through the tables, longer ones through zlib.
_TABLED = 63


@dataclass(frozen=True)
class Settings:
    """``percent`` of the documents with at least ``least_words`` words are drawn; features fall in ``buckets`` buckets."""

    buckets: int = 10_000
    least_words: int = 20
    percent: int = 5
    seed: int = 42


def _crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """The byte table of CRC-32, and for n zero bytes the four tables that push a checksum past them."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    past = np.zeros((_TABLED + 2, 4, 256), np.uint32)
    past[0] = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, len(past)):
        past[n] = table[past[n - 1] & 255] ^ (past[n - 1] >> 8)
    return table, past


_TABLE, _PAST = _crc_tables()


def _after(crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``crc`` moved past ``size`` zero bytes; the checksum of a + b is _after(crc(a), len(b)) ^ crc(b)."""
    out = _PAST[size, 0, crc & 255]
    for k in range(1, 4):
        out ^= _PAST[size, k, (crc >> (8 * k)) & 255]
    return out


def word_crcs(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of each stretch of bytes of ``data``, all stretches advancing byte by byte together."""
    order = np.argsort(-size, kind="stable")
    begin, left = start[order], size[order]
    crc = np.full(len(start), 0xFFFFFFFF, np.uint32)
    counts = np.bincount(np.minimum(left, _TABLED + 1), minlength=_TABLED + 2)
    longer = np.cumsum(counts[::-1])[::-1]  # stretches of at least n bytes
    for at in range(min(int(left[0]), _TABLED) if len(left) else 0):
        n = int(longer[at + 1])
        crc[:n] = _TABLE[(crc[:n] ^ data[begin[:n] + at]) & 255] ^ (crc[:n] >> 8)
    out = np.empty(len(start), np.uint32)
    out[order] = ~crc
    for i in np.flatnonzero(size > _TABLED):
        out[i] = zlib.crc32(data[start[i] : start[i] + size[i]].tobytes())
    return out


def spaced(text: bytes) -> bytes:
    """A-Z lower-cased, separators collapsed to single spaces."""
    return b" ".join(text.lower().translate(_SPACED).split())


def _span_crcs(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(start, checksum) of the runs of one, two and three words, from the longest run at every word.

    Of a block that is not the last, the last three words only complete the runs before them.
    """
    n = len(begin)
    far = np.iinfo(np.int64).max
    second = np.concatenate((begin[1:], [far]))[:n]
    third = np.concatenate((begin[2:], [far, far]))[:n]
    two, three = second < end, third < end
    first_end = np.where(two, second - 1, end)
    second_end = np.where(three, third - 1, end)
    size = first_end - begin
    words = word_crcs(data, begin, size)
    yield begin, words
    space = np.uint32(zlib.crc32(b" "))
    short = size <= _TABLED
    capped = np.minimum(size, _TABLED)
    spaced_words = _after(np.full(n, space), capped) ^ words  # of " " + word
    at2 = np.flatnonzero(two)
    pairs = np.zeros(n, np.uint32)
    pairs[at2] = _after(words[at2], capped[at2 + 1] + 1) ^ spaced_words[at2 + 1]
    at3 = np.flatnonzero(three)
    triples = _after(pairs[at3], capped[at3 + 2] + 1) ^ spaced_words[at3 + 2]
    for i in at2[~short[at2 + 1]]:
        pairs[i] = zlib.crc32(data[begin[i] : second_end[i]].tobytes())
    for k in np.flatnonzero(~(short[at3 + 1] & short[at3 + 2])):
        triples[k] = zlib.crc32(data[begin[at3[k]] : end[at3[k]]].tobytes())
    yield begin[at2], pairs[at2]
    yield begin[at3], triples


def bucket_counts(texts: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every text its words, its features and its distinct buckets with their counts.

    Returns words and features a text, distinct buckets a text, then buckets
    (ascending within a text) and counts of all texts in a row. Matches are
    worked off in blocks, so that a very long text needs little more memory than
    its own bytes.
    """
    plain = [spaced(x) for x in texts]
    joined = b"  ".join(plain)  # two spaces: no run crosses them
    offsets = np.cumsum([0, *(len(x) + 2 for x in plain)])
    data = np.frombuffer(joined, np.uint8)
    words = np.zeros(len(texts), np.int64)
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    matches = map(_SPAN, _RUNS.finditer(joined, overlapped=True))
    carry = np.zeros(0, np.int64)
    while True:
        flat = np.fromiter(itertools.chain.from_iterable(itertools.islice(matches, _MATCHES)), np.int64)
        ended = len(flat) < 2 * _MATCHES
        spans = np.concatenate((carry, flat)).reshape(-1, 2)
        # the last three wait: a word's end is known by the word behind it
        done = len(spans) if ended else len(spans) - 3
        carry = spans[done:].reshape(-1)
        limit = spans[done, 0] if done < len(spans) else len(joined) + 1
        new = []
        for n, (start, crc) in enumerate(_span_crcs(data, spans[:, 0], spans[:, 1])):
            inside = start < limit
            text = np.searchsorted(offsets, start[inside], side="right") - 1
            new.append(text * buckets + crc[inside] % buckets)
            if n == 0:
                words += np.bincount(text, minlength=len(texts))
        some, number = np.unique(np.concatenate(new), return_counts=True)
        both = np.concatenate((keys, some))
        keys, place = np.unique(both, return_inverse=True)
        counts = np.bincount(place, weights=np.concatenate((counts, number)), minlength=len(keys)).astype(np.int64)
        if ended:
            break
    text = keys // buckets
    features = np.bincount(text, weights=counts, minlength=len(texts)).astype(np.int64)
    return words, features, np.bincount(text, minlength=len(texts)), keys % buckets, counts


def _slices(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) in slices of a few MB; null is empty."""
    first, held, size = 0, [], 0
    for i, value in enumerate(texts.cast(pa.large_binary())):
        held.append(value.as_py() or b"")
        size += len(held[-1])
        if size >= _SLICE_BYTES:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


_PACKED = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "n_features")] + [T.StructField(n, T.BinaryType()) for n in ("steps", "counts")]
)


def hashed(docs: DataFrame, settings: Settings, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, n_words, n_features and its distinct buckets, as 16-bit steps from one to the next, with 32-bit counts."""
    buckets = settings.buckets
    if buckets > 1 << 16:
        raise ValueError("at most 65536 buckets")
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _slices(batch.column(1)):
                words, features, sizes, places, counts = bucket_counts(texts, buckets)
                edges = np.cumsum(sizes) - sizes
                steps = np.diff(places, prepend=0)
                steps[edges[sizes > 0]] = places[edges[sizes > 0]]
                packed = []
                for values in (steps.astype("<u2"), counts.astype("<u4")):
                    ends = np.concatenate(([0], np.cumsum(sizes * values.itemsize))).astype(np.int32)
                    packed.append(pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(values.tobytes())]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), pa.array(words), pa.array(features), *packed], names=["id", *_PACKED.names]
                )

    return source.mapInArrow(run, T.StructType([source.schema["id"], *_PACKED]))


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, buckets, counts) of the rows with features."""
    for i, (steps, counts) in enumerate(zip(batch.column("steps"), batch.column("counts"), strict=True)):
        raw = steps.as_py()
        if raw:
            yield i, np.cumsum(np.frombuffer(raw, "<u2"), dtype=np.int64), np.frombuffer(counts.as_py(), "<u4").astype(np.int64)


def bucket_totals(table: DataFrame, buckets: int) -> np.ndarray:
    """Features of each bucket over all rows: summed in the tasks, then by bucket; the driver gets one number a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, places, counts in _unpacked(batch):
                total[places] += counts
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in table.select("steps", "counts").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares in target and source, rounded down."""
    n = float(len(source))
    ratio = (target + 1.0) * (source.sum() + n) / ((source + 1.0) * (target.sum() + n))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weighted(table: DataFrame, gains: np.ndarray) -> DataFrame:
    """id, n_words, n_features, weight: the sum of the gains of a row's features."""
    shipped = table.sparkSession.sparkContext.broadcast(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shipped.value
        for batch in batches:
            weight = np.zeros(batch.num_rows, np.int64)
            for i, places, counts in _unpacked(batch):
                weight[i] = int(gain[places] @ counts)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight)], names=["id", "n_words", "n_features", "weight"])

    kept = T.StructType([table.schema["id"], table.schema["n_words"], table.schema["n_features"], T.StructField("weight", T.LongType())])
    return table.select("id", "n_words", "n_features", "steps", "counts").mapInArrow(run, kept)


def resample(
    docs: DataFrame, target: DataFrame, settings: Settings = Settings(),
    id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
) -> DataFrame:
    """Every row's id, n_features, weight, score and rank; the ranked rows are a draw towards ``target``.

    1. One scan of the texts: separators collapse to single spaces, and an
       overlapped regular expression with boundary lookarounds gives the span of
       the longest run of up to three words at every word, hence the spans of the
       shorter runs. Their CRC-32 (of whole spans, checksums of words joined by
       the shift of a CRC past zero bytes) falls in a bucket. A written table
       keeps each row's distinct buckets with counts; texts are not read again.
    2. Buckets are summed over all rows of both tables; the gains, one number a
       bucket, go back to the tasks and give each row's weight.
    3. A draw without replacement: weight plus Gumbel noise from a seeded digest
       of the id. The largest scores get ranks 1, 2, 3, ...: rows are sorted over
       range partitions, and a partition's ranks begin where the one before ends.

    Null and empty texts have no features, weight 0 and no rank. Texts of any
    length are scanned whole. Repeated rows are counted and drawn each. A null id
    takes part with the digest of "42:"; ties go to the smaller id, nulls
    first. Extra columns are ignored. An empty table gives no rows; an empty
    target leaves all to the corpus's rare features.
    """
    s = settings
    table = stored(hashed(docs, s, id_col, text_col), "resample-buckets", compression="zstd")
    wanted = hashed(target.select(F.lit(0).alias("id"), F.col(target_text).alias("text")), s, "id", "text")
    gains = bucket_gains(bucket_totals(table, s.buckets), bucket_totals(wanted, s.buckets))
    digest = F.sha2(F.concat(F.lit(f"{s.seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = weighted(table, gains).withColumn("score", F.col("weight") + noise).withColumn("open", F.col("n_words") < s.least_words)
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "resample-weights")
    spark = docs.sparkSession
    n = spark.range(0).count() if rows.isEmpty() else rows.where("not open").count()
    drawn = s.percent * n // 100
    order = [F.col("open"), F.col("score").desc(), F.col("id"), F.col("row")]
    ordered = rows.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order)
    ordered = stored(ordered.withColumn("place", F.monotonically_increasing_id()), "resample-order")
    part = F.shiftright("place", 33)
    # one row a partition of the sort: where its ranks begin
    sizes = sorted(ordered.where("not open").groupBy(part.alias("part")).count().collect())
    begins = itertools.accumulate((count for _, count in sizes), initial=0)
    starts = spark.createDataFrame([(p, b) for (p, _), b in zip(sizes, begins)], "part long, begin long")
    ranked = ordered.withColumn("part", part).join(F.broadcast(starts), "part", "left")
    rank = F.col("begin") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return ranked.select(
        F.col("id").alias(id_col), "n_features", "weight", "score", F.when(~F.col("open") & (rank <= drawn), rank).alias("rank")
    )


def oracle_sql(settings: Settings = Settings()) -> str:
    """The draw in DuckDB SQL."""
    s = settings
    letters = "abcdefghijklmnopqrstuvwxyz"

    def words(table: str) -> str:
        plain = f"translate(coalesce(text, ''), '{letters.upper()}', '{letters}')"
        return rf"regexp_extract_all({plain}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {table}"

    runs = ("list_concat(w, list_concat(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), "
            "list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))")
    h = f"('0x' || substr(sha256('{s.seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT"
    return f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS uid, doc_id, {words('documents')}),
grams AS MATERIALIZED (SELECT uid, f, count(*) AS n FROM (SELECT uid, unnest({runs}) AS f FROM docs) x GROUP BY ALL),
wanted AS MATERIALIZED (SELECT f, count(*) AS n FROM (SELECT unnest({runs}) AS f FROM (SELECT {words('benchmark')}) y) x GROUP BY ALL),
names AS (SELECT f FROM grams UNION SELECT f FROM wanted),
hashed AS MATERIALIZED (SELECT f, ({crc32_sql('f')} % {s.buckets})::BIGINT AS bucket FROM names),
src AS (SELECT bucket, sum(n)::DOUBLE AS s FROM grams JOIN hashed USING (f) GROUP BY bucket),
tgt AS (SELECT bucket, sum(n)::DOUBLE AS t FROM wanted JOIN hashed USING (f) GROUP BY bucket),
totals AS (SELECT (SELECT coalesce(sum(s), 0) FROM src) AS sa, (SELECT coalesce(sum(t), 0) FROM tgt) AS ta),
gains AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * (sa + {s.buckets}) / ((s + 1) * (ta + {s.buckets}))))::BIGINT AS g
          FROM src LEFT JOIN tgt USING (bucket) CROSS JOIN totals),
sums AS (SELECT uid, sum(n)::BIGINT AS n_features, sum(n * g)::BIGINT AS weight
         FROM grams JOIN hashed USING (f) JOIN gains USING (bucket) GROUP BY uid),
scored AS (SELECT uid, doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
                  (coalesce(weight, 0) + floor(-1000 * ln(-ln(({h} + 0.5) / 4294967296.0::DOUBLE))))::BIGINT AS score
           FROM docs LEFT JOIN sums USING (uid)),
ranked AS (SELECT uid, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS r FROM scored WHERE n_words >= {s.least_words})
SELECT doc_id, n_features, weight, score,
       CASE WHEN r <= {s.percent} * (SELECT count(*) FROM ranked) // 100 THEN r END::BIGINT AS rank
FROM scored LEFT JOIN ranked USING (uid)"""
