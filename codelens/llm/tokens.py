"""Token ids of a public tokenizer, computed in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelens.llm.common import worker_state

#: Words whose ids a worker remembers before it starts afresh (memory only).
REMEMBERED = 1_000_000
#: Bytes of text that are handled at once inside an Arrow batch (memory only).
SLICE_BYTES = 6 << 20
#: Letters that stay one letter each under lower-casing and composition: the Latin ones below U+0250 but U+0130 and U+0149.
_LETTERS = "[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u024f]+"
#: Such letters and the ASCII punctuation behind them, which tokenizers of this kind cut off.
_STEM_AND_TAIL = f"^(?P<stem>{_LETTERS})(?P<tail>[!-/:-@\\[-`{{-~]*)$"


class WordEncoder:
    """Ids of whole texts from ids of their words.

    For tokenizers that drop white space and never join across it, the ids of a
    text are the ids of its words between ASCII white space, one after the
    other. Arrow finds the distinct words of a slice and cuts the punctuation off
    words of plain letters; every distinct part is encoded once per worker. Plain
    words are encoded many to a call and told apart by the end-of-word pieces.
    """

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        for piece, i in vocab.items():
            self.ends[i] = piece.endswith("</w>")
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.zeros(1 << 20, np.uint32)
        self.begin = np.zeros(1 << 18, np.int64)
        self.size = np.zeros(1 << 18, np.int32)
        self.used = 0
        self._put([""], np.zeros(0, np.uint32), np.zeros(1, np.int64))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of ids of each; null is empty."""
        if len(self.index) > REMEMBERED:
            self.clear()
        words = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        offsets = words.offsets.to_numpy()
        coded = words.flatten().dictionary_encode()
        parts = pc.extract_regex(coded.dictionary, _STEM_AND_TAIL)
        stem, tail = pc.struct_field(parts, "stem"), pc.struct_field(parts, "tail")
        place = np.stack([self._places(pc.coalesce(stem, coded.dictionary)), self._places(pc.fill_null(tail, ""))], 1)
        at = place.take(coded.indices.to_numpy(), axis=0).ravel()
        size = self.size.take(at)
        edges = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
        return self._gather(at, size), np.diff(edges[2 * (offsets - offsets[0])])

    def _places(self, words: pa.Array) -> np.ndarray:
        """Where the ids of each word are; those not met before are encoded."""
        coded = words.dictionary_encode()
        distinct = distinct_strings(coded.dictionary)
        known = self.index.get
        place = np.array([known(w, -1) for w in distinct], np.int64)
        new = np.flatnonzero(place < 0)
        if len(new):
            unknown = [distinct[i] for i in new.tolist()]
            self._learn(unknown)
            place[new] = [self.index[w] for w in unknown]
        return place.take(coded.indices.to_numpy())

    def _gather(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        total = int(size.sum())
        first = np.cumsum(size, dtype=np.int64) - size
        return self.flat[np.repeat(self.begin[at] - first, size) + np.arange(total)]

    def _learn(self, new: list[str]) -> None:
        words = pa.array(new, pa.large_string())
        plain = pc.match_substring_regex(words, f"^{_LETTERS}$")
        letters, other = words.filter(plain).to_pylist(), words.filter(pc.invert(plain)).to_pylist()
        for i in range(0, len(letters), 512):
            self._learn_letters(letters[i : i + 512])
        self._learn_each(other)

    def _learn_letters(self, words: list[str]) -> None:
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) == len(words) and ends[-1] == len(ids):
            self._put(words, ids, np.diff(ends, prepend=0))
        else:
            self._learn_each(words)

    def _learn_each(self, words: list[str]) -> None:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        self._put(words, np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids], np.int64))

    def _put(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        first, n = len(self.index), len(words)
        while first + n > len(self.begin):
            self.begin, self.size = np.resize(self.begin, 2 * len(self.begin)), np.resize(self.size, 2 * len(self.size))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + len(ids)] = ids
        self.begin[first : first + n] = self.used + np.cumsum(sizes) - sizes
        self.size[first : first + n] = sizes
        self.index.update(zip(words, range(first, first + n), strict=True))
        self.used += len(ids)


def distinct_strings(words: pa.Array) -> list[str]:
    """Words without white space as a list; joined and split, which is much faster than one by one."""
    if not len(words):
        return []
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), pa.scalar(" ", words.type))
    return joined[0].as_py().split(" ")


def arrow_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(index of the first, rows) for runs of rows with about ``most`` bytes each."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    run = np.cumsum(sizes, dtype=np.int64) // most
    edges = np.flatnonzero(np.append(True, run[1:] != run[:-1])).tolist() + [len(sizes)] if len(sizes) else []
    for first, end in zip(edges[:-1], edges[1:], strict=True):
        yield first, column.slice(first, end - first)


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts as bytes) for runs of about ``most`` bytes; null is empty."""
    values = column.cast(pa.large_binary())
    run, size, first = [], 0, 0
    for i in range(len(values)):
        v = values[i].as_buffer()
        run.append(b"" if v is None else v.to_pybytes())
        size += len(run[-1])
        if size >= most:
            yield first, run
            run, size, first = [], 0, i + 1
    if run:
        yield first, run


def term_counts(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, count) of texts of these sizes one after the other, by document, then term.

    16-bit ids of fewer than 65,536 texts are put in order by two radix sorts.
    """
    if ids.dtype.itemsize > 2 or len(sizes) >= 1 << 16:
        doc = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
        pairs, counts = np.unique((doc << np.uint64(32)) | ids, return_counts=True)
        return (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64), counts
    by_term = np.argsort(ids, kind="stable")
    doc = np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes).take(by_term)
    by_doc = np.argsort(doc, kind="stable")
    doc, term = doc.take(by_doc), ids.take(by_term).take(by_doc)
    begin = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (doc[1:] != doc[:-1]))[: len(term)])
    return doc.take(begin).astype(np.int64), term.take(begin).astype(np.int64), np.diff(begin, append=len(term))


def id_type(tokenizer_json: str, end_id: int | None) -> str:
    """Little-endian unsigned 16-bit if all ids fit, else 32-bit."""
    from tokenizers import Tokenizer

    most = max([*Tokenizer.from_str(tokenizer_json).get_vocab(with_added_tokens=True).values(), end_id or 0])
    return "<u2" if most < 1 << 16 else "<u4"


def encoded(docs: DataFrame, tokenizer_json: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids (binary, of ``id_type``) of every row's whole text, ``end_id`` last."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(tokenizer_json)
    kind = id_type(tokenizer_json, end_id)
    tail = np.array([] if end_id is None else [end_id], kind)

    def run(batches):
        state = worker_state("tokens")
        key = ("encoder", hash(shipped.value))
        if key not in state:
            state[key] = WordEncoder(shipped.value)
        encoder = state[key]
        for batch in batches:
            for first, texts in arrow_slices(batch.column(1)):
                ids, sizes = encoder.encode(texts)
                parts = np.split(ids.astype(kind), np.cumsum(sizes)[:-1])
                blobs = [p.tobytes() + tail.tobytes() for p in parts]
                counts = pa.array(sizes + len(tail), pa.int64())
                keys = batch.column(0).slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([keys, counts, pa.array(blobs, pa.binary())], names=[id_col, "n_tokens", "ids"])

    key_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"{id_col} {key_type}, n_tokens long, ids binary")
