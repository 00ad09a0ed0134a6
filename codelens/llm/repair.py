"""Conversation structure repair: cheapest edits by a dynamic program that keeps cost vectors at checkpoints only."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelens.llm.common import crc32_sql, shuffle_width, stored

#: States of a repaired conversation: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 60
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: The role that an inserted or reroled turn takes in a state, and the state after it.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}
#: What keeping a turn with this initial leads to, by state; a state not named here does not allow it.
KEEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: A block has at most 2**12 turns; as a block is one group, this bounds a task's group.
BLOCK_BITS = 12
FAULTS = ("", "blank", "duplicate", "truncated")
OK, BLANK, DUPLICATE, CUT = range(4)
END_COSTS = (0, FAR, FAR, 0)


def _relaxed(cost: list[int]) -> tuple[int, ...]:
    """Costs to the end from each state, when turns may be inserted first."""
    for _ in range(2):
        cost = [min(c, INSERT + cost[NEXT[q]]) for q, c in enumerate(cost)]
    return tuple(cost)


def _moves(initial: str, fault: int) -> list[list[tuple[str, int, int]]]:
    """By state the (edit, cost, next state) of one turn."""
    out = []
    for q in range(4):
        moves = [("D", DELETE, q)]
        if fault not in (BLANK, DUPLICATE):
            extra = TRUNCATED if fault == CUT else 0
            if q in KEEP.get(initial, {}):
                moves.append(("K", extra, KEEP[initial][q]))
            moves.append(("R", REROLE + extra, NEXT[q]))
        out.append(moves)
    return out


MOVES = {(i, f): _moves(i, f) for i in (*KEEP, "") for f in range(4)}


def _before(code: tuple[str, int], after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to the end before a turn, from the costs behind it."""
    return _relaxed([min(c + after[p] for _, c, p in moves) for moves in MOVES[code]])


def backward(codes: list[tuple[str, int]], end: tuple[int, ...]) -> tuple[int, ...]:
    for code in reversed(codes):
        end = _before(code, end)
    return end


def forward(codes: list[tuple[str, int]], end: tuple[int, ...], state: int, last: bool) -> Iterator[tuple[str, int, int]]:
    """(edit, turn or -1, state after it): the cheapest edits from ``state``, of equally cheap ones the ASCII-least.

    Costs to the end are stored at every square-root-th turn. Walking forward,
    the vectors of one stretch are computed again from the checkpoint behind it.
    A move is tight if its cost and the cost behind it make the cost in front;
    the least letter among the tight moves is taken, and as a letter leads to one
    state alone, the letters are the least string.
    ``last``: the conversation ends here, so turns may also be inserted at the end.
    """
    n = len(codes)
    stride = max(1, math.isqrt(n))
    checkpoints = {n: end}
    after = end
    for i in range(n - 1, -1, -1):
        after = _before(codes[i], after)
        if i % stride == 0:
            checkpoints[i] = after
    for begin in range(0, n, stride):
        stop = min(begin + stride, n)
        vectors = [checkpoints[stop]]
        for i in range(stop - 1, begin - 1, -1):
            vectors.append(_before(codes[i], vectors[-1]))
        vectors.reverse()
        for i in range(begin, stop):
            here, behind = vectors[i - begin], vectors[i - begin + 1]
            moved = False
            while not moved:
                tight = [m for m in MOVES[codes[i]][state] if m[1] + behind[m[2]] == here[state]]
                if INSERT + here[NEXT[state]] == here[state]:
                    tight.append(("I", INSERT, NEXT[state]))
                edit, _, state = min(tight)
                moved = edit != "I"
                yield edit, i if moved else -1, state
    while last and end[state] > 0:
        state = NEXT[state]
        yield "I", -1, state


def edit_cost(edit: str, fault: int) -> int:
    extra = TRUNCATED if fault == CUT else 0
    return {"D": DELETE, "I": INSERT, "K": extra, "R": REROLE + extra}[edit]


def transfer(codes: list[tuple[str, int]]) -> list[tuple[int, ...]]:
    """Cheapest way through a block from every state (row) to every state (column): the block as one matrix."""
    columns = []
    for target in range(4):
        end = [FAR] * 4
        end[target] = 0
        columns.append(backward(codes, tuple(end)))
    return [tuple(min(FAR, columns[t][q]) for t in range(4)) for q in range(4)]


def flagged_rows(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per turn: conv_id, turn, role, text, digest, copy (0 for the first of equal rows), fault (number in FAULTS)."""
    rows = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"),
    ).withColumn("digest", F.sha2("text", 256))
    rows = stored(rows.groupBy("conv_id", "turn", "role", "digest").agg(F.any_value("text").alias("text"), F.count(F.lit(1)).alias("n")), "repair-turns")
    number = F.struct(F.col("turn").isNotNull().alias("has"), F.coalesce("turn", F.lit(0)).alias("turn"))
    first = rows.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(number).alias("first"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    # equal rows become one before they are shuffled and copies again behind the join
    each = rows.join(stored(first, "repair-first"), same).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    space = r"[\x20\x09-\x0D]"
    fault = (
        F.when(F.col("text").rlike(rf"\A{space}*\z"), BLANK)
        .when((F.col("copy") > 0) | (number != F.col("first")), DUPLICATE)
        .when(~F.col("text").rlike(rf"[.!?]{space}*\z"), CUT)
        .otherwise(OK)
    )
    return each.select("conv_id", "turn", "role", "text", "digest", "copy", fault.cast("int").alias("fault"))


def _codes(part: pd.DataFrame) -> list[tuple[str, int]]:
    return [(i if i in KEEP else "", f) for i, f in zip(part["initial"], part["fault"], strict=True)]


def _pieces(block: pd.DataFrame) -> Iterator[tuple[object, pd.DataFrame, bool]]:
    """(conversation, its rows in order, whether it touches the block's edge)."""
    block = block.sort_values("place", kind="stable")
    key = block["conv"].to_numpy()
    edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield key[a], block.iloc[a:b], a == 0 or b == len(key)


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Every turn with its edit, and every inserted turn, in order.

    A repaired conversation's role initials are ``(s?(ua)+)?``. Keeping a turn
    costs nothing, another role (user or assistant) 3, deleting 4, inserting an
    empty user or assistant turn 3; a truncated turn that stays adds 3; blank and
    duplicate turns must go. Of the cheapest edits those whose initials (K, R, D, I)
    are ASCII-least are taken.

    Columns: conv_id, block, step (together the order), edit, turn, role and text
    of the input (null for an inserted turn), fault ("", "blank", "duplicate",
    "truncated"), new_role (null if deleted), new_text, cost.

    1. Faults: equal rows are counted before they are shuffled; a conversation's
       first (role, text) comes from partial minima.
    2. Turns are sorted over range partitions by conversation, turn, role, digest
       of the text, and cut into blocks of at most 4,096, so that a conversation
       of any length is many bounded groups.
    3. Where a conversation crosses a block's edge, the block's part of it becomes a
       4x4 matrix of costs. The matrices of one conversation, one small row a
       block, give the cost vector behind each of its blocks: the checkpoints.
    4. A block with its checkpoint tells, for each state in which it may be entered, the
       state it is left in; in order of blocks that gives the state before each.
    5. Every block walks forward from its state. Inside a block, too, vectors are
       stored at each square-root-th turn and computed again in between.

    Null roles and texts count as one space (a blank turn); a null turn comes
    first; a null conv_id is a conversation of its own. Turns of one number go by
    role, then by SHA-256 of the text. Repeated rows are duplicates. Extra columns
    are ignored. An empty table gives no rows. A conversation whose turns are all
    deleted, and to which nothing is added, has its deletions alone.
    """
    flagged = flagged_rows(turns, conv, turn, role, text)
    order = ["conv_id", "turn", "role", "digest", "copy"]
    flagged = stored(flagged, "repair-flagged")
    ordered = flagged.repartitionByRange(shuffle_width(turns.sparkSession), *order).sortWithinPartitions(*order)
    rows = stored(ordered.withColumn("place", F.monotonically_increasing_id()), "repair-order")
    # a partition's number is the place's high part: blocks do not cross partitions
    rows = rows.withColumn("block", F.shiftright("place", BLOCK_BITS))
    conv_type = rows.schema["conv_id"].dataType.simpleString()
    # the conversation travels as text inside pandas, where a null number would turn all into floats
    codes = rows.select("block", "place", F.col("conv_id").cast("string").alias("conv"), F.substring("role", 1, 1).alias("initial"), "fault")
    # these rows are small but costly: dealt by number, they are not merged into few tasks for their bytes
    codes = codes.repartition(shuffle_width(turns.sparkSession), "block")

    def matrices(block: pd.DataFrame) -> pd.DataFrame:
        out = [(part["block"].iloc[0], c, sum(transfer(_codes(part)), ())) for c, part, edge in _pieces(block) if edge]
        return pd.DataFrame(out, columns=["block", "conv", "matrix"])

    def chained(parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values("block")
        after, out = END, []
        for block, c, matrix in zip(parts["block"][::-1], parts["conv"][::-1], parts["matrix"][::-1], strict=True):
            out.append((block, c, list(after), len(out) == 0))
            after = tuple(min(FAR, min(int(matrix[4 * q + t]) + after[t] for t in range(4))) for q in range(4))
        return pd.DataFrame(out, columns=["block", "conv", "costs", "last"])

    END = _relaxed(list(END_COSTS))
    parts = stored(codes.groupBy("block").applyInPandas(matrices, "block bigint, conv string, matrix array<bigint>"), "repair-matrices")
    ends = stored(parts.groupBy("conv").applyInPandas(chained, "block bigint, conv string, costs array<bigint>, last boolean"), "repair-ends")

    def known(pieces: pd.DataFrame) -> dict:
        return {_key(r["conv"]): r for r in pieces.to_dict("records")}

    def exits(key: tuple, block: pd.DataFrame, pieces: pd.DataFrame) -> pd.DataFrame:
        out, ends = [], known(pieces)
        for c, part, edge in _pieces(block):
            if edge:
                end, left = ends[_key(c)], []
                for state in range(4):
                    q = state
                    for _, _, q in forward(_codes(part), tuple(int(x) for x in end["costs"]), state, False):
                        pass
                    left.append(q)
                out.append((key[0], c, left))
        return pd.DataFrame(out, columns=["block", "conv", "left"])

    def entered(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values("block")
        state, states = START, []
        for left in pieces["left"]:
            states.append(state)
            state = int(left[state])
        return pd.DataFrame({"block": pieces["block"], "conv": pieces["conv"], "state": states})

    by_block = codes.groupBy("block").cogroup(ends.groupBy("block"))
    left = stored(by_block.applyInPandas(exits, "block bigint, conv string, left array<int>"), "repair-exits")
    states = left.groupBy("conv").applyInPandas(entered, "block bigint, conv string, state int")
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))
    plan = stored(ends.join(states.select(F.col("block").alias("b"), F.col("conv").alias("c"), "state"), same).drop("b", "c"), "repair-plan")

    def walked(key: tuple, block: pd.DataFrame, pieces: pd.DataFrame) -> pd.DataFrame:
        plan, out, step = known(pieces), [], 0
        for c, part, edge in _pieces(block):
            p = plan[_key(c)] if edge else {"costs": END, "state": START, "last": True}
            places, faults = part["place"].tolist(), part["fault"].tolist()
            for edit, at, state in forward(_codes(part), tuple(int(x) for x in p["costs"]), int(p["state"]), bool(p["last"])):
                place, fault = (None, OK) if at < 0 else (places[at], faults[at])
                out.append((key[0], step, c, place, edit, ROLE[state] if edit in "IR" else None, edit_cost(edit, fault)))
                step += 1
        frame = pd.DataFrame(out, columns=["block", "step", "conv", "place", "edit", "made", "cost"])
        return frame.astype({"place": "Int64"})

    schema = "block bigint, step bigint, conv string, place bigint, edit string, made string, cost bigint"
    edits = stored(codes.groupBy("block").cogroup(plan.groupBy("block")).applyInPandas(walked, schema), "repair-edits")
    full = rows.select("place", "turn", "role", "text", "fault")
    # inserted turns have no place: they do not take part in the join, where a null key would be a hot one
    new = edits.where(F.col("place").isNull()).select(*edits.columns, *[F.lit(None).cast(full.schema[c].dataType).alias(c) for c in full.columns[1:]])
    out = edits.join(full, "place").select(*new.columns).union(new)
    kept = F.col("edit") != "D"
    return out.select(
        F.col("conv").cast(conv_type).alias("conv_id"), "block", "step", "edit", "turn", "role", "text",
        F.element_at(F.array(*[F.lit(f) for f in FAULTS]), F.coalesce("fault", F.lit(0)) + 1).alias("fault"),
        F.when(kept, F.coalesce("made", "role")).alias("new_role"), F.when(kept, F.coalesce("text", F.lit(""))).alias("new_text"), "cost",
    )


def _key(c: object) -> object:
    """A null conversation is None or NaN in pandas."""
    return c if isinstance(c, str) else None


def damaged(turns: DataFrame) -> DataFrame:
    """``conversations`` with seeded faults: rows dropped, emptied, cut short, repeated or given to the user."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(name) % 20).alias("kind")
    ).where("kind <> 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), "kind")
    return rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.sequence(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("kind", "copy")


class _Tally:
    """What a conversation's steps, read in order, come to."""

    def __init__(self, conv: object):
        self.conv = conv
        self.turns: list[int | None] = [None, None]  # the first and the last number
        self.distinct = self.illegal = self.cost = 0
        self.faults = dict.fromkeys(FAULTS, 0)
        self.before: str | None = None
        self.audit: list[str] = []
        self.sha = hashlib.sha256()
        self.any = False

    def add(self, edit: str, turn: int | None, role: str | None, fault: str, new_role: str | None, new_text: str | None, cost: int) -> None:
        self.audit.append(edit)
        self.cost += cost
        if edit != "I":
            self.faults[fault] += 1
            pair = None if self.before is None else self.before + role[:1]
            self.illegal += pair not in (None, "su", "ua", "au")
            self.before = role[:1]
            if turn is not None and turn != self.turns[1]:
                self.distinct += 1
                self.turns = [turn if self.turns[0] is None else self.turns[0], turn]
        if edit != "D":
            self.sha.update((("\n" if self.any else "") + f"{new_role}:{new_text}").encode())
            self.any = True

    def row(self) -> tuple:
        first, last = self.turns
        gaps = 0 if first is None else last - first + 1 - self.distinct
        return (self.conv, gaps, *(self.faults[f] for f in FAULTS[1:]), self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest())


REPORT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def report(turns: DataFrame, steps: DataFrame) -> DataFrame:
    """One row per conv_id of ``turns``: the counts and digests of its ``repair`` steps.

    Steps of a conversation are sorted in one partition and streamed: a SHA-256 is
    sequential by its nature, so its text passes one task, but is never held there.
    """
    conv_type = turns.schema["conv_id"].dataType.simpleString()
    columns = ["edit", "turn", "role", "fault", "new_role", "new_text", "cost"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Tally | None = None
        for batch in batches:
            done = []
            values = batch.to_pydict()
            for conv, *step in zip(values["conv"], *(values[c] for c in columns), strict=True):
                if now is None or now.conv != conv:
                    done += [now.row()] if now else []
                    now = _Tally(conv)
                now.add(*step)
            yield _report_batch(done)
        yield _report_batch([now.row()] if now else [])

    sorted_steps = steps.repartition("conv_id").sortWithinPartitions("conv_id", "block", "step")
    found = sorted_steps.select(F.col("conv_id").cast("string").alias("conv"), *columns).mapInArrow(run, f"conv string, {REPORT}")
    ids = turns.select("conv_id").distinct()
    all_ids = ids.join(found, F.col("conv_id").cast("string").eqNullSafe(F.col("conv")), "left")
    zeros = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return all_ids.select(
        F.col("conv_id").cast(conv_type), *zeros, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def oracle_sql() -> str:
    """``report`` of the repaired, damaged ``conversations`` in DuckDB SQL.

    The program runs forward here: for every state the least "cost, edits so far".
    """

    def more(x: str, cost: str, edit: str) -> str:
        return f"lpad((substr({x}, 1, 9)::INTEGER + {cost})::VARCHAR, 9, '0') || substr({x}, 10) || '{edit}'"

    def relaxed(source: str) -> str:
        for _ in range(2):
            source = (
                f"(SELECT * REPLACE (least(s3, {more('s2', '3', 'I')}) AS s3) FROM (SELECT * REPLACE (least(s2, {more('s0', '3', 'I')}, "
                f"{more('s1', '3', 'I')}, {more('s3', '3', 'I')}) AS s2) FROM {source} x) x)"
            )
        return source

    stays, extra = "f IN (0, 3)", "CASE WHEN f = 3 THEN 3 ELSE 0 END"
    k = {q: more(f"s{q}", extra, "K") for q in range(4)}
    r = {q: more(f"s{q}", f"3 + {extra}", "R") for q in range(4)}
    d = {q: more(f"s{q}", "4", "D") for q in range(4)}
    name = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
    space = r"[\x20\x09-\x0D]"
    return rf"""
WITH RECURSIVE raw AS MATERIALIZED (
  SELECT conv_id, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS cid, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc32_sql(name)} % 20 AS k FROM conversations),
dam AS (
  SELECT cid, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
         CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy
  FROM raw WHERE k <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM dam),
seq AS MATERIALIZED (
  SELECT cid, i, turn, role, text, substr(role, 1, 1) AS c,
         CASE WHEN regexp_full_match(text, '{space}*') THEN 1 WHEN row_number() OVER (PARTITION BY cid, role, text ORDER BY i) > 1 THEN 2
              WHEN NOT regexp_matches(text, '[.!?]{space}*\z') THEN 3 ELSE 0 END AS f
  FROM placed),
counts AS (
  SELECT cid, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
         count(*) FILTER (f = 1) AS blank, count(*) FILTER (f = 2) AS duplicate, count(*) FILTER (f = 3) AS truncated
  FROM seq GROUP BY cid),
illegal AS (
  SELECT cid, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT cid, lag(c) OVER (PARTITION BY cid ORDER BY i) || c AS pair FROM seq) x GROUP BY cid),
dp AS (
  SELECT cid, 0::BIGINT AS i, '000000000' AS s0, NULL::VARCHAR AS s1, NULL::VARCHAR AS s2, NULL::VARCHAR AS s3 FROM counts
  UNION ALL
  SELECT cid, i, {d[0]}, least({d[1]}, CASE WHEN {stays} AND c = 's' THEN {k[0]} END),
         least({d[2]}, CASE WHEN {stays} AND c = 'u' THEN least({k[0]}, {k[1]}, {k[3]}) END, CASE WHEN {stays} THEN least({r[0]}, {r[1]}, {r[3]}) END),
         least({d[3]}, CASE WHEN {stays} AND c = 'a' THEN {k[2]} END, CASE WHEN {stays} THEN {r[2]} END)
  FROM (SELECT t.cid, q.i, q.c, q.f, t.s0, t.s1, t.s2, t.s3 FROM {relaxed('dp')} t JOIN seq q ON q.cid = t.cid AND q.i = t.i + 1) z),
best AS (
  SELECT cid, substr(b, 1, 9)::BIGINT AS cost, substr(b, 10) AS audit
  FROM (SELECT cid, least(s0, s3) AS b FROM {relaxed('(SELECT dp.* FROM dp JOIN counts USING (cid) WHERE i = n)')} e) x),
walk AS (
  SELECT cid, 0::BIGINT AS k, 0::BIGINT AS i, 0 AS state, ''::VARCHAR AS edit, NULL::VARCHAR AS piece FROM best
  UNION ALL
  SELECT cid, k, i, state, edit,
         CASE edit WHEN 'K' THEN role || ':' || text WHEN 'R' THEN made || ':' || text WHEN 'I' THEN made || ':' END
  FROM (
    SELECT w.cid, w.k + 1 AS k, CASE WHEN e = 'I' THEN w.i ELSE w.i + 1 END AS i, e AS edit, q.role, q.text,
           CASE WHEN w.state = 2 THEN 'assistant' ELSE 'user' END AS made,
           CASE WHEN e = 'D' THEN w.state WHEN e = 'K' AND q.c = 's' THEN 1 WHEN w.state = 2 THEN 3 ELSE 2 END AS state
    FROM (SELECT walk.*, substr(audit, walk.k::INTEGER + 1, 1) AS e FROM walk JOIN best USING (cid) WHERE walk.k < length(audit)) w
    LEFT JOIN seq q ON q.cid = w.cid AND q.i = w.i + 1) z),
repaired AS (SELECT cid, string_agg(piece, chr(10) ORDER BY k) AS r FROM walk WHERE piece IS NOT NULL GROUP BY cid)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(r, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, cid FROM raw) c
LEFT JOIN counts USING (cid) LEFT JOIN illegal USING (cid) LEFT JOIN best USING (cid) LEFT JOIN repaired USING (cid)"""


def _report_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), *[pa.int64()] * 6, pa.string(), pa.string()]
    names = ["conv", *(x.split()[0] for x in REPORT.split(", "))]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)
