"""Secret scans: fixed patterns, and strings whose sliding windows are too random for words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelens.llm.common import text_or_empty

CANDIDATE = r"[A-Za-z0-9+/_.=-]"
LEAST_CANDIDATE = 16
KEYWORD = r"password|passwd|secret|token|api_?key"
BASE = ("assign", "access", "hex")
#: Fractions of a bit in which window sums are kept: whole numbers, so that steps add up exactly.
UNIT = 1 << 40


@dataclass(frozen=True)
class CharClass:
    """Characters of a class, the window's length, and the bits a character from which a window counts as random."""

    name: str
    chars: str
    window: int
    bits: float


@dataclass(frozen=True)
class Settings:
    """``allowed``: patterns that a whole candidate string matches if it is known to be no secret."""

    classes: tuple[CharClass, ...] = (
        CharClass("entropy_hex", "[0-9A-Fa-f]", 20, 3.0),
        CharClass("entropy_alnum", "[0-9A-Za-z]", 20, 3.75),
        CharClass("entropy_base64", "[0-9A-Za-z+/_=-]", 24, 4.0),
    )
    allowed: tuple[str, ...] = (
        r"[0-9._=-]+",  # numbers, dates, versions
        r"(?:[A-Z]?[a-z]+|[A-Z]+)(?:[+/_.=-]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4}))*[+/_.=-]*",  # words, paths, hosts
        r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",  # a UUID names, it does not open
        r".*(?:0123456789|abcdefghijkl|ABCDEFGHIJKL).*",  # alphabets
        r".*(?:EXAMPLE|example|XXXXXXXX|xxxxxxxx).*",  # documentation
    )

    @property
    def kinds(self) -> tuple[str, ...]:
        return (*BASE, *(c.name for c in self.classes))


def window_sums(codes: np.ndarray, run: np.ndarray, window: int) -> np.ndarray:
    """For every place, the sum of c*log2(c) over the counts c of the window that ends there.

    ``codes``: characters of runs laid end to end; ``run``: each place's run, ascending.
    The window moves by one character: the count of the one that leaves falls,
    the count of the one that comes rises, and the sum takes the difference of
    the two terms. Both counts are read off the sorted places of that character
    in that run. Only places with a whole window behind them are meaningful.
    """
    n = len(codes)
    table = np.arange(window + 1, dtype=np.float64)
    table[2:] *= np.log2(table[2:]) * UNIT
    table[:2] = 0
    table = np.rint(table).astype(np.int64)
    key = (run.astype(np.int64) * 256 + codes) * (n + window)
    at = np.arange(n)
    places = np.sort(key + at)
    rank = np.searchsorted(places, key + at)
    first = np.searchsorted(run, run)
    came = rank - np.searchsorted(places, key + np.maximum(at - window + 1, first)) + 1
    change = table[came] - table[came - 1]
    leaving = np.flatnonzero(at - window >= first)
    gone = leaving - window
    had = np.searchsorted(places, key[gone] + leaving - 1, side="right") - rank[gone]
    change[leaving] += table[had - 1] - table[had]
    total = np.cumsum(change)
    before = np.concatenate(([0], total))[first]
    return total - before


class Scanner:
    """Compiled patterns of one worker's tasks."""

    def __init__(self, settings: Settings):
        self.settings = settings
        self.candidate = re.compile(rf"{CANDIDATE}{{{LEAST_CANDIDATE},}}")
        self.assign = re.compile(rf"(?ai:({KEYWORD}))[\"']?\x20*[:=]\x20*[\"']?({CANDIDATE}+)")
        self.access = re.compile(r"AKIA[A-Z0-9]+")
        self.hex = re.compile(r"[0-9a-f]{32,}")
        self.allowed = re.compile("|".join(f"(?:{p})" for p in settings.allowed)) if settings.allowed else None
        self.runs = [re.compile(f"{c.chars}{{{c.window},}}") for c in settings.classes]

    def spans(self, texts: pa.Array) -> list[list[tuple[int, int, int]]]:
        """Of every text (start, number of the kind, end), sorted."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
        runs: list[list[tuple[int, int, str]]] = [[] for _ in self.runs]
        for i in np.flatnonzero(pc.match_substring_regex(texts, f"(?i){KEYWORD}").to_numpy(zero_copy_only=False)).tolist():
            for m in self.assign.finditer(texts[i].as_py()):
                if m.end() - m.start(2) >= 8:
                    out[i].append((m.start(), 0, m.end()))
        # every other kind lies inside a candidate string
        for i in np.flatnonzero(pc.match_substring_regex(texts, f"{CANDIDATE}{{{LEAST_CANDIDATE}}}").to_numpy(zero_copy_only=False)).tolist():
            for m in self.candidate.finditer(texts[i].as_py()):
                self._candidate(i, m.start(), m.group(), out[i], runs)
        for number, found in enumerate(runs):
            for i, span in self._random(number, found):
                out[i].append(span)
        return [sorted(x) for x in out]

    def _candidate(self, row: int, begin: int, value: str, out: list, runs: list) -> None:
        for m in self.access.finditer(value):
            if m.end() - m.start() >= 16:
                out.append((begin + m.start(), 1, begin + m.end()))
        for m in self.hex.finditer(value):
            out.append((begin + m.start(), 2, begin + m.end()))
        if self.allowed is None or not self.allowed.fullmatch(value):
            for pattern, found in zip(self.runs, runs, strict=True):
                found.extend((row, begin + m.start(), m.group()) for m in pattern.finditer(value))

    def _random(self, number: int, found: list[tuple[int, int, str]]) -> Iterator[tuple[int, tuple[int, int, int]]]:
        """Windows over the class's bits, joined where they overlap or touch."""
        if not found:
            return
        c = self.settings.classes[number]
        sizes = np.array([len(value) for _, _, value in found])
        codes = np.frombuffer("".join(value for _, _, value in found).encode("ascii"), np.uint8)
        run = np.repeat(np.arange(len(found)), sizes)
        offset = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        # entropy = log2(window) - sum / window; half a millionth of a bit for rounded terms
        most = (np.log2(c.window) - c.bits + 5e-7) * c.window * UNIT
        last = np.flatnonzero((offset >= c.window - 1) & (window_sums(codes, run, c.window) <= most))
        if not len(last):
            return
        new = np.concatenate(([True], (np.diff(last) > c.window) | (np.diff(run[last]) != 0)))
        heads, tails = last[new], last[np.concatenate((new[1:], [True]))]
        for head, tail in zip(heads.tolist(), tails.tolist(), strict=True):
            row, begin, _ = found[run[head]]
            yield row, (begin + int(offset[head]) - c.window + 1, len(BASE) + number, begin + int(offset[tail]) + 1)


def found_secrets(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Every row's id and ``spans`` (start, rank, kind, end), sorted by start, then kind; with ``keep_text`` also the text.

    Fixed patterns: a keyword with an assigned string of 8 or more characters
    (``assign``), access key ids (``access``), lower-case hex strings of 32 or
    more (``hex``). Besides, of every candidate string (16 or more characters of
    keys, paths and words) that no allow-list pattern matches whole, the runs of
    each character class are read by a window that moves one character at a time;
    windows whose Shannon entropy reaches the class's bits are joined to spans of
    the class's kind. The allow-list takes away windows, never fixed patterns.

    Places are code points, end exclusive. One pass, no shuffle: rows are scanned
    where they are read. Null and empty texts have no spans. A text of any length
    is scanned whole. Repeated rows are rows of their own; a null id stays null.
    Extra columns are ignored. An empty table gives no rows.
    """
    kinds = list(settings.kinds)
    rank_type = pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("kind", pa.string()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(settings)
        for batch in batches:
            found = scanner.spans(batch.column(1))
            flat = [x for row in found for x in row]
            starts, ranks, ends = ([x[k] for x in flat] for k in range(3))
            values = pa.StructArray.from_arrays(
                [pa.array(starts, pa.int64()), pa.array(ranks, pa.int32()), pa.array([kinds[r] for r in ranks], pa.string()), pa.array(ends, pa.int64())],
                fields=list(rank_type),
            )
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in found]))), pa.int32())
            columns = [batch.column(0), pa.ListArray.from_arrays(offsets, values)]
            yield pa.RecordBatch.from_arrays(columns + [batch.column(1)] * keep_text, names=["id", "spans", "text"][: 2 + keep_text])

    source = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    schema = f"id {kind}, spans array<struct<start:bigint,rank:int,kind:string,end:bigint>>" + (", text string" if keep_text else "")
    out = source.mapInArrow(run, schema)
    return out.select(F.col("id").alias(id_col), "spans", *([F.col("text").alias(text_col)] if keep_text else []))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


def report(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans."""
    found = found_secrets(docs, settings, id_col, text_col)
    counts = [F.size(F.filter("spans", _of_kind(k))).cast("long").alias(f"n_{k}") for k in BASE]
    more = F.size(F.filter("spans", lambda s: s["rank"] >= len(BASE))).cast("long").alias("n_entropy")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return found.select(F.col(id_col), *counts, more, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def masked(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and text, with every stretch that spans cover replaced by "[SECRET]"."""
    found = found_secrets(docs, settings, id_col, text_col, keep_text=True)
    text = F.col(text_col)
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        between = F.substr(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        grown = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
        fresh = F.struct(s["end"].alias("at"), F.concat(acc["out"], between, F.lit("[SECRET]")).alias("out"))
        return F.when((s["start"] < acc["at"]) | ((s["start"] == acc["at"]) & (acc["at"] > 0)), grown).otherwise(fresh)

    done = F.aggregate("spans", zero, step, lambda acc: F.concat(acc["out"], F.substr(text, (acc["at"] + 1).cast("int"), F.length(text))))
    return found.select(F.col(id_col), F.when(F.size("spans") > 0, done).otherwise(text).alias(text_col))


def oracle_sql(settings: Settings = Settings()) -> str:
    """The report in DuckDB SQL: every window's entropy is taken anew from its characters."""

    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    # [Pp] and the like instead of a flag, which would fold letters beyond ASCII too
    keyword = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in KEYWORD)
    base = {
        "assign": rf"(?:{keyword})[\"']?\x20*[:=]\x20*[\"']?{CANDIDATE}+",
        "access": "AKIA[A-Z0-9]+",
        "hex": "[0-9a-f]{32,}",
    }
    value_of = rf"^(?:{keyword})[\"']?\x20*[:=]\x20*[\"']?"
    valid = {"assign": f"length(regexp_replace(v, {quoted(value_of)}, '')) >= 8", "access": "length(v) >= 16", "hex": "true"}

    def located(source: str, key: str, text: str, pattern: str) -> str:
        """(key, i, v, s): match i and where it starts, from the pieces between the matches."""
        return (
            f"SELECT {key}, i, vs[i] AS v, list_sum(list_transform(ps[1:i], lambda p: length(p))) "
            f"+ coalesce(list_sum(list_transform(vs[1:i-1], lambda p: length(p))), 0) AS s FROM ("
            f"SELECT {key}, regexp_extract_all({text}, {quoted(pattern)}) AS vs, regexp_split_to_array({text}, {quoted(pattern)}) AS ps, "
            f"unnest(range(1, len(regexp_extract_all({text}, {quoted(pattern)})) + 1)) AS i FROM {source}) z"
        )

    ctes = ["docs AS MATERIALIZED (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS text FROM documents)"]
    parts = []
    for rank, kind in enumerate(BASE):
        ctes.append(f"m_{kind} AS ({located('docs', 'uid', 'text', base[kind])})")
        parts.append(f"SELECT uid, {rank} AS rank, '{kind}' AS kind, s::BIGINT AS s, (s + length(v))::BIGINT AS e FROM m_{kind} WHERE {valid[kind]}")
    ctes.append(f"cands AS ({located('docs', 'uid', 'text', f'{CANDIDATE}{{{LEAST_CANDIDATE},}}')})")
    free = " AND ".join(f"NOT regexp_full_match(v, {quoted(p)})" for p in settings.allowed) or "TRUE"
    ctes.append(f"open AS (SELECT uid, i AS cand, v AS word, s AS b0 FROM cands WHERE {free})")
    for number, c in enumerate(settings.classes):
        w, rank = c.window, len(BASE) + number
        ctes.append(f"r_{number} AS ({located('open', 'uid, b0', 'word', f'{c.chars}{{{w},}}')})")
        ctes.append(
            f"w_{number} AS (SELECT uid, b0, i, b0 + s + k AS pos FROM (SELECT *, unnest(range(0, length(v) - {w - 1})) AS k FROM r_{number}) x "
            f"WHERE list_aggregate(string_split(substr(v, k::INTEGER + 1, {w}), ''), 'entropy') >= {c.bits})"
        )
        ctes.append(
            f"g_{number} AS (SELECT uid, b0, i, pos, sum(new) OVER (PARTITION BY uid, b0, i ORDER BY pos) AS g FROM (SELECT *, CASE WHEN "
            f"pos - lag(pos) OVER (PARTITION BY uid, b0, i ORDER BY pos) <= {w} THEN 0 ELSE 1 END AS new FROM w_{number}) x)"
        )
        parts.append(f"SELECT uid, {rank}, '{c.name}', min(pos)::BIGINT, (max(pos) + {w})::BIGINT FROM g_{number} GROUP BY uid, b0, i, g")
    ctes.append("spans AS (" + " UNION ALL ".join(parts) + ")")
    name = "kind || ':' || s || ':' || e"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)
    ctes.append(
        f"per AS (SELECT uid, {counts}, count(*) FILTER (rank >= {len(BASE)}) AS n_entropy, string_agg({name}, ',' ORDER BY s, rank) "
        f"FILTER (rank < {len(BASE)}) AS base, string_agg({name}, ',' ORDER BY s, rank) AS spans FROM spans GROUP BY uid)"
    )
    shown = ", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in (*BASE, "entropy"))
    return "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, {shown}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN per USING (uid)"
