"""TF-IDF with one row per document, and the jobs built on it.

Weights follow the smoothed formula: idf = ln((1 + n) / (1 + df)) + 1,
w = tf * idf, then L2-normalised per document (MLlib's ``IDF`` has no ``+1``,
so the formula is written out).

* ``bags``: a document's tokens are sorted and counted by Arrow and numpy, some megabytes of
  texts at a time, so term counts need no shuffle at all and texts never move. The bags are written
  once (a reliable checkpoint); the text is not read again.
* document frequency is a partial aggregate keyed by term: a stop word of every
  document costs one combined row per map task.
* ``weighted_bags``: (document, term) rows exist once, between the explode of the
  bags and the aggregate that puts a document's terms back in its row. idf of the most frequent
  terms (at most ``BROADCAST_MAX_TERMS``, counted first) is broadcast, and a document's rows are still
  side by side in one task: they are collected before the one exchange, which moves a row a document.
  Rows of rarer terms are joined by term, where AQE splits a hot one.
* the norm's squares are summed by the same aggregate.
* ``tfidf`` gives the same as (doc, term, tf, weight) rows; ``in_place`` they stay in their document's task: only the
  sum of squares and idf of rare terms are brought to the bags.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelens.functions.text import strip_ws, tokenize_words

WEIGHT_DECIMALS = 6
MIN_TOKEN_LEN = 2


def by_doc(docs: DataFrame, doc: str) -> DataFrame:
    """Hash-partition documents by id (one exchange shared by every per-doc step)."""
    return docs.repartition(doc)


# idf is broadcast for at most this many terms (about 50 bytes each), the most
# frequent ones; rows of other terms are joined by term.
BROADCAST_MAX_TERMS = 2_000_000
# Sums of squares are broadcast for at most this many documents; with more, they meet the bags in a shuffle.
BROADCAST_MAX_ROWS = 1_000_000
NO_PLACE = 2**31 - 1


def run_starts(sorted_rows: str, field: str | None = None) -> Column:
    """Places where a run of equal values (of ``field``, if they are structs) begins in a sorted array column."""

    def at(i: Column) -> Column:
        return F.get(sorted_rows, i)[field] if field else F.get(sorted_rows, i)

    changed = F.filter(F.sequence(F.lit(0), F.size(sorted_rows) - 1), lambda i: (i == 0) | (at(i) != at(i - 1)))
    return F.when(F.size(sorted_rows) > 0, changed).otherwise(F.array().cast("array<int>"))


# Ends of words or sentences in a prepared text. A place counts the marks before it.
MARK = "\u0001"
# texts counted at a time in a task
SLICE_BYTES = 1 << 22


@dataclass(frozen=True)
class Tokens:
    """A text made ready for ``bags``: lower-case letters, a space for anything else, ``MARK`` between places.

    ``words``: the text with the same marks and nothing else changed; a token has a place
    only if it is the whole of its word there. Without it every token has one.
    """

    text: Column
    placed: bool = False
    words: Column | None = None


def _letters(text: Column, letters: str, but: str = "") -> Column:
    kept = "a-z" if letters == "ascii" else r"\p{L}"
    return F.regexp_replace(F.lower(text), f"[^{kept}{but}]+", " ")


def plain_tokens(text: str, letters: str = "unicode") -> Tokens:
    """Tokens without places."""
    return Tokens(_letters(F.col(text), letters))


def word_tokens(text: str, letters: str = "unicode") -> Tokens:
    """Tokens with the number of the white-space word that they are the whole of, if they are."""
    # a mark of the text itself is no letter, nor is what it becomes
    words = F.regexp_replace(F.translate(F.col(text), MARK, "\u0002"), r"\s+", MARK)
    return Tokens(_letters(words, letters, MARK), True, words)


def sentence_tokens(text: str, letters: str = "unicode") -> Tokens:
    """Tokens with the number of their sentence."""
    return Tokens(_letters(F.regexp_replace(F.col(text), SENTENCE_END, "$1" + SENTENCE_MARK), letters, MARK), True)


def _counted(text: pa.Array, words: pa.Array | None, placed: bool, places: int | None) -> list[pa.Array]:
    """For every prepared text its distinct tokens in order, joined by spaces, and their counts; with places
    also where those that each token keeps begin, and these in a row."""
    n, place = len(text), None
    doc = np.arange(n)
    if placed:
        parts = pc.split_pattern(text, MARK)
        sizes = pc.list_value_length(parts).to_numpy()
        doc, text = np.repeat(doc, sizes), parts.flatten()
        place = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        if words is not None:
            whole = pc.equal(text, pc.split_pattern(words, MARK).flatten()).to_numpy(zero_copy_only=False)
            place = np.where(whole, place, NO_PLACE)
    parts = pc.split_pattern(text, " ")
    sizes = pc.list_value_length(parts).to_numpy()
    tokens = parts.flatten()
    kept = pc.greater_equal(pc.utf8_length(tokens), MIN_TOKEN_LEN)
    mask = kept.to_numpy(zero_copy_only=False)
    coded = tokens.filter(kept).dictionary_encode()
    by_name = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(by_name), np.int64)
    rank[by_name] = np.arange(len(by_name))
    width = max(1, len(by_name))
    key = np.repeat(doc, sizes)[mask] * width + rank[coded.indices.to_numpy()]
    if place is None:
        key.sort()
    else:
        order = np.argsort(key, kind="stable")  # places stay in order
        key, place = key[order], np.repeat(place, sizes)[mask][order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    tf = np.diff(np.append(first, len(key)))
    entries = key[first]
    begin = np.searchsorted(entries, np.arange(n + 1) * width)
    offsets = pa.array(begin, pa.int32())
    terms = pc.binary_join(pa.ListArray.from_arrays(offsets, coded.dictionary.take(pa.array(by_name[entries % width]))), " ")
    out = [terms, pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int32()))]
    if place is None:
        return out
    real = place < NO_PLACE
    before = np.cumsum(real) - real
    if places is not None:
        real &= before - np.repeat(before[first], tf) < places
    ends = np.cumsum(np.append(0, real))
    starts = ends[np.append(first, len(key))]  # of each entry, within the whole
    each = pa.ListArray.from_arrays(offsets, pa.array(starts[:-1] - np.repeat(starts[begin[:-1]], np.diff(begin)), pa.int32()))
    return [*out, each, pa.ListArray.from_arrays(pa.array(starts[begin], pa.int32()), pa.array(place[real], pa.int32()))]


def bags(docs: DataFrame, doc: str, tokens: Tokens, places: int | None = 0) -> DataFrame:
    """(_row, doc, bag) with bag an array of (term, tf, places); one row per input row, written once.

    ``places``: how many of a term's first places to keep (None: all). A null or
    empty text has an empty bag. What is written are the terms as one string and
    arrays of numbers, some 15 bytes a term; ``weighted_bags`` reads these columns
    (_terms, _tfs, _starts, _places), and ``bag`` is made of them where it is asked for.
    """
    placed = tokens.placed and places != 0
    names = ["_terms", "_tfs", "_starts", "_places"][: 4 if placed else 2]
    kinds = [T.StringType()] + [T.ArrayType(T.IntegerType())] * (len(names) - 1)
    worded = tokens.words is not None and placed
    text = F.coalesce(tokens.text if placed or not tokens.placed else F.translate(tokens.text, MARK, " "), F.lit(""))
    source = docs.select(F.col(doc), text.alias("_text"), *([F.coalesce(tokens.words, F.lit("")).alias("_words")] if worded else []))

    def run(batches):
        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy())
            first = 0
            while first < batch.num_rows:
                done = ends[first - 1] if first else 0
                n = max(1, int(np.searchsorted(ends, done + SLICE_BYTES, "right")) - first)
                part = batch.slice(first, n)
                found = _counted(part.column(1), part.column(2) if worded else None, placed, places)
                yield pa.RecordBatch.from_arrays([part.column(0), *found], names=[doc, *names])
                first += n

    schema = T.StructType([source.schema[doc], *[T.StructField(c, k) for c, k in zip(names, kinds, strict=True)]])
    rows = source.mapInArrow(run, schema).withColumn("_row", F.monotonically_increasing_id()).checkpoint(eager=True)
    empty = F.array().cast("array<struct<term:string,tf:bigint,places:array<int>>>")
    entries = F.transform(F.split("_terms", " "), lambda t, i: F.struct(
        t.alias("term"), F.get("_tfs", i).cast("long").alias("tf"), _places_at(placed, i).alias("places")))
    bag = F.when(F.size("_tfs") > 0, entries).otherwise(empty)
    return rows.select("_row", doc, bag.alias("bag"), *names)


def _places_at(placed: bool, i: Column) -> Column:
    if not placed:
        return F.array().cast("array<int>")
    start = F.get("_starts", i)
    return F.slice("_places", start + 1, F.coalesce(F.get("_starts", i + 1), F.size("_places")) - start)


def top_terms(rows: DataFrame, max_features: int) -> DataFrame:
    """The ``max_features`` terms with the largest corpus count (ties: term asc).
    A bounded top-k: each partition keeps at most max_features rows."""
    totals = rows.groupBy("term").agg(F.sum("tf").alias("total"))
    return totals.orderBy(F.col("total").desc(), F.col("term").asc()).limit(max_features).select("term")


def _least_broadcast(df: DataFrame) -> int | None:
    """The least document frequency (at most 1,000) that so few terms reach that their idf can be broadcast."""
    counts = {r["_least"]: r["n"] for r in df.groupBy(F.least("_df", F.lit(1000)).alias("_least")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total, least = 0, None
    for d in range(1000, 0, -1):
        total += counts.get(d, 0)
        if total > BROADCAST_MAX_TERMS:
            break
        least = d
    return least


def _gathered(bag_rows: DataFrame, doc: str, max_features: int | None = None, broadcast: bool | None = None) -> DataFrame:
    """(_row, doc, _terms, _square): a document's terms as an array of (term, tf, w[, places]) and the sum of w * w."""
    n_docs = bag_rows.count()
    some = bag_rows.where(F.size("_tfs") > 0)
    placed = "_places" in some.columns
    of_doc = ["_row", doc, "_tfs", *(["_starts", "_places"] if placed else [])]
    rows = some.select(*of_doc, F.posexplode(F.split("_terms", " ")).alias("_i", "term"))
    i = F.col("_i")
    more = [_places_at(True, i).alias("places")] if placed else []
    rows = rows.select("_row", doc, "term", F.get("_tfs", i).cast("long").alias("tf"), *more)
    if max_features:
        rows = rows.join(F.broadcast(top_terms(rows, max_features).checkpoint(eager=True)), "term", "left_semi")
    df = rows.groupBy("term").agg(F.count(F.lit(1)).alias("_df")).checkpoint(eager=True)
    idf = df.select("term", (F.log(F.lit(n_docs + 1) / (F.col("_df") + 1)) + 1).alias("_idf"), "_df")
    least = _least_broadcast(df) if broadcast is None else 1 if broadcast else None
    if least is None:
        found = rows.join(idf.drop("_df"), "term")
    elif least == 1:
        found = rows.join(F.broadcast(idf.drop("_df")), "term")
    else:
        common = F.broadcast(idf.where(F.col("_df") >= least).drop("_df"))
        rare = idf.where(F.col("_df") < least).drop("_df")
        found = rows.join(common, "term").unionByName(rows.join(common.select("term"), "term", "left_anti").join(rare, "term"))
    weighed = found.withColumn("_w", F.col("tf") * F.col("_idf"))
    terms = F.collect_list(F.struct("term", "tf", "_w", *(["places"] if placed else [])))
    return weighed.groupBy("_row", doc).agg(terms.alias("_terms"), F.sum(F.col("_w") * F.col("_w")).alias("_square"))


def _weight(w: Column) -> Column:
    return F.round(w / F.sqrt("_square"), WEIGHT_DECIMALS)


def weighted_bags(bag_rows: DataFrame, doc: str, max_features: int | None = None, broadcast: bool | None = None) -> DataFrame:
    """(doc, terms) with terms an array of (term, tf, places, weight): smoothed, L2-normalised TF-IDF.

    ``broadcast``: None counts the vocabulary and broadcasts idf of the most frequent terms, up to
    ``BROADCAST_MAX_TERMS``; rows of rarer ones, a small part, meet theirs in a shuffle.
    """
    places = (lambda t: t["places"]) if "_places" in bag_rows.columns else (lambda t: F.array().cast("array<int>"))
    terms = F.transform("_terms", lambda t: F.struct(
        t["term"].alias("term"), t["tf"].alias("tf"), places(t).alias("places"), _weight(t["_w"]).alias("weight")))
    return _gathered(bag_rows, doc, max_features, broadcast).select("_row", doc, terms.alias("terms"))


def tfidf(docs: DataFrame, doc: str, text: str, max_features: int | None = None, letters: str = "unicode",
          in_place: bool = False) -> DataFrame:
    """(doc, term, tf, weight) with the smoothed, L2-normalised TF-IDF weight.

    ``in_place``: a document's terms are not moved, but exploded twice."""
    bag_rows = bags(docs, doc, plain_tokens(text, letters))
    found = _in_place(bag_rows, doc) if in_place and not max_features else None
    if found is None:
        found = _gathered(bag_rows, doc, max_features).select(doc, "_square", F.explode("_terms").alias("t")).select(doc, "_square", "t.*")
    return found.select(doc, "term", "tf", _weight(F.col("_w")).alias("weight"))


def _in_place(bag_rows: DataFrame, doc: str) -> DataFrame | None:
    """(doc, term, tf, _w, _square) rows without moving a document's terms: the sum of squares, and idf of terms too rare
    to be broadcast, are brought to its bag, and the terms stay in its task. None if no idf can be broadcast."""
    n_docs = bag_rows.count()
    some = bag_rows.where(F.size("_tfs") > 0)
    i = F.col("_i")

    def terms(rows: DataFrame, *more: str) -> DataFrame:
        each = rows.select("_row", doc, "_tfs", *more, F.posexplode(F.split("_terms", " ")).alias("_i", "term"))
        return each.select("_row", doc, "_i", "term", F.get("_tfs", i).cast("long").alias("tf"), *more)

    rows = terms(some)
    df = rows.groupBy("term").agg(F.count(F.lit(1)).alias("_df")).checkpoint(eager=True)
    idf = df.select("term", (F.log(F.lit(n_docs + 1) / (F.col("_df") + 1)) + 1).alias("_idf"), "_df")
    least = _least_broadcast(df)
    if least is None:
        return None
    common = F.broadcast(idf.where(F.col("_df") >= least).drop("_df"))
    w = F.col("tf") * F.col("_idf")
    none = F.array().cast("array<struct<_i:int,_idf:double>>")
    squares = rows.join(common, "term").groupBy("_row").agg(F.sum(w * w).alias("_square")).withColumn("_rare", none)
    if least > 1:
        rare = rows.join(common.select("term"), "term", "left_anti").join(idf.where(F.col("_df") < least).drop("_df"), "term")
        squares = squares.unionByName(rare.groupBy("_row").agg(F.sum(w * w).alias("_square"), F.collect_list(F.struct("_i", "_idf")).alias("_rare")))
        squares = squares.groupBy("_row").agg(F.sum("_square").alias("_square"), F.flatten(F.collect_list("_rare")).alias("_rare"))
    squares = squares.checkpoint(eager=True)
    if squares.count() <= BROADCAST_MAX_ROWS:
        squares = F.broadcast(squares)
    found = terms(some.join(squares, "_row"), "_square", "_rare").join(common, "term", "left")
    own = F.filter("_rare", lambda x: x["_i"] == i)
    return found.withColumn("_idf", F.coalesce("_idf", F.get(own, F.lit(0))["_idf"])).select(doc, "term", "tf", w.alias("_w"), "_square")


def condense(docs: DataFrame, doc: str, text: str, threshold: float = 0.1, top_tokens: int = 10, letters: str = "unicode") -> DataFrame:
    """(doc, condensed): the first ``top_tokens`` words of each text (white-space split, original order, repeats
    kept) whose weight in that document is >= threshold, joined with spaces.

    The bags carry the first places of each term, so neither texts nor words are
    shuffled or read again. Documents without such words get ''.
    """
    rows = bags(docs, doc, word_tokens(text, letters), top_tokens)
    found = _gathered(rows, doc)
    weighty = F.filter("_terms", lambda t: _weight(t["_w"]) >= threshold)
    hits = F.flatten(F.transform(weighty, lambda t: F.transform(t["places"], lambda p: F.struct(p.alias("place"), t["term"].alias("term")))))
    first = F.transform(F.slice(F.sort_array(hits), 1, top_tokens), lambda h: h["term"])
    found = found.select(doc, F.array_join(first, " ").alias("condensed"))
    return found.unionByName(rows.where(F.size("_tfs") == 0).select(doc, F.lit("").alias("condensed")))


def important_terms(weights: DataFrame, threshold: float = 0.1) -> DataFrame:
    return weights.where(F.col("weight") >= threshold)


def condense_text(docs: DataFrame, doc: str, text: str, weights: DataFrame, threshold: float = 0.1,
                  top_tokens: int = 10) -> DataFrame:
    """Words of the text (whitespace split, original order, repeats kept) whose
    term weight in that document is >= threshold; the first ``top_tokens``
    joined with spaces. Documents with none get ''."""
    docs = by_doc(docs, doc)
    words = docs.select(F.col(doc), F.posexplode(F.split(F.col(text), r"\s+")).alias("pos", "term"))
    keep = important_terms(weights, threshold).select(doc, "term")
    hits = words.join(keep, [doc, "term"], "left_semi")
    w = Window.partitionBy(doc).orderBy("pos")
    first = hits.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= top_tokens)
    cond = first.groupBy(doc).agg(F.expr("listagg(term, ' ') WITHIN GROUP (ORDER BY pos)").alias("condensed"))
    return docs.select(doc).join(cond, doc, "left").select(doc, F.coalesce("condensed", F.lit("")).alias("condensed"))


# Sentence boundary: end mark followed by whitespace. The mark stays with its
# sentence; a control character marks the cut (no lookbehind, so the same rule
# runs in RE2-based engines).
SENTENCE_END = r"([.!?])\s+"
SENTENCE_MARK = "\u0001"


def split_sentences(c):
    return F.split(F.regexp_replace(c, SENTENCE_END, "$1" + SENTENCE_MARK), SENTENCE_MARK)


def extractive_summary(docs: DataFrame, doc: str, text: str, weights: DataFrame, max_words: int = 60,
                       letters: str = "unicode") -> DataFrame:
    """Best sentences by summed term weight, kept while the running word count
    (best first) stays within ``max_words`` (the best sentence is always kept),
    then printed in original order. A document without sentences gets ''."""
    docs = by_doc(docs, doc)
    sent = docs.select(F.col(doc), F.posexplode(split_sentences(F.col(text))).alias("s_pos", "sentence"))
    sent = sent.withColumn("sentence", strip_ws("sentence")).where(F.length("sentence") > 0)
    sent = sent.withColumn("n_words", F.size(F.split("sentence", r"\s+")))
    toks = sent.select(doc, "s_pos", F.explode(tokenize_words("sentence", letters)).alias("term"))
    scored = toks.join(weights.select(doc, "term", "weight"), [doc, "term"]).groupBy(doc, "s_pos").agg(
        F.round(F.sum("weight"), WEIGHT_DECIMALS).alias("score")
    )
    s = sent.join(scored, [doc, "s_pos"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    w = Window.partitionBy(doc).orderBy(F.col("score").desc(), F.col("s_pos")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    s = s.withColumn("_cum", F.sum("n_words").over(w)).withColumn("_rk", F.row_number().over(
        Window.partitionBy(doc).orderBy(F.col("score").desc(), F.col("s_pos"))))
    picked = s.where((F.col("_cum") <= max_words) | (F.col("_rk") == 1))
    found = picked.groupBy(doc).agg(
        F.expr("listagg(sentence, ' ') WITHIN GROUP (ORDER BY s_pos)").alias("summary")
    )
    return docs.select(doc).join(found, doc, "left").select(doc, F.coalesce("summary", F.lit("")).alias("summary"))


def _run_sum(rows: str, begin: str, first: Column, i: Column) -> Column:
    """Rounded sum of w over the ``i``th run of a sorted array of (place, w)."""
    n = F.coalesce(F.get(begin, i + 1), F.size(rows)) - first
    return F.round(F.aggregate(F.slice(rows, first + 1, n), F.lit(0.0), lambda acc, x: acc + x["w"]), WEIGHT_DECIMALS)


def _place_sums(found: DataFrame, doc: str) -> DataFrame:
    """(doc, _each) from gathered terms with places: for every place with a term, (place, w) with the sum of its weights."""
    each = F.flatten(F.transform("_terms", lambda t: F.transform(t["places"], lambda p: F.struct(p.alias("place"), _weight(t["_w"]).alias("w")))))
    found = found.select(doc, F.sort_array(each).alias("_words"))
    found = found.withColumn("_runs", run_starts("_words", "place"))
    sums = F.transform("_runs", lambda first, i: F.struct(
        F.get("_words", first)["place"].alias("place"), _run_sum("_words", "_runs", first, i).alias("w")))
    return found.select(doc, sums.alias("_each"))


def summarise(docs: DataFrame, doc: str, text: str, max_words: int = 60, letters: str = "unicode") -> DataFrame:
    """``extractive_summary`` with the text's own weights, in rows: (doc, summary).

    The bags carry the sentence of every token, so a sentence's score is summed in
    its document's row. Texts are moved once, to meet their scores (one a sentence, not
    one a word) by ``doc``, which names one row.
    """
    rows = bags(docs, doc, sentence_tokens(text, letters), None)
    found = _place_sums(_gathered(rows, doc), doc).withColumnRenamed(doc, "_doc")
    # a sentence without a weighty word has a run of its own too
    sentences = docs.select(F.col(doc), split_sentences(F.col(text)).alias("_sent")).withColumn("_sent", F.transform("_sent", strip_ws))
    zeros = F.transform(F.sequence(F.lit(0), F.size("_sent") - 1), lambda i: F.struct(i.alias("place"), F.lit(0.0).alias("w")))
    joined = sentences.join(found, F.col(doc) == F.col("_doc"), "left").drop("_doc")
    none = F.array().cast("array<struct<place:int,w:double>>")
    joined = joined.withColumn("_all", F.when(F.size("_sent") > 0, F.sort_array(F.concat(F.coalesce("_each", none), zeros))).otherwise(none))
    joined = joined.withColumn("_begin", run_starts("_all", "place"))

    def scored(first: Column, i: Column) -> Column:
        words = F.size(F.split(F.get("_sent", i), r"\s+"))
        return F.struct((-_run_sum("_all", "_begin", first, i)).alias("neg"), i.alias("place"), words.alias("words"))

    ranked = F.filter(F.transform("_begin", scored), lambda x: F.length(F.get("_sent", x["place"])) > 0)
    joined = joined.withColumn("_ranked", F.sort_array(ranked))
    start = F.struct(F.lit(0).alias("words"), F.lit(0).alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        words = acc["words"] + x["words"]
        return F.struct(words.alias("words"), (acc["kept"] + (words <= max_words).cast("int")).alias("kept"))

    # running word counts only grow: the sentences within the bound are the first ones
    kept = F.greatest(F.aggregate("_ranked", start, step)["kept"], F.lit(1))
    places = F.sort_array(F.transform(F.slice("_ranked", 1, kept), lambda x: x["place"]))
    summary = F.array_join(F.transform(places, lambda p: F.get("_sent", p)), " ")
    return joined.select(doc, F.coalesce(summary, F.lit("")).alias("summary"))
