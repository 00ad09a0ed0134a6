"""Personal data: exact patterns, and terms that reveal them (DataFrame functions only)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelens.llm.common import stored, text_or_empty

KINDS = ("email", "ip", "card", "phone", "term")

# Written so that they match in one pass without backtracking or recursion: a match can
# only begin where a run begins or the last match ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_IP = rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"
_LONG_NUMBER = r"[0-9](?:[\x20-]?[0-9]){11,}+"
TERM = r"\p{L}[\p{L}\p{N}_'-]*+"


@dataclass(frozen=True)
class Settings:
    """Shares of an entity's information, from 0 to 1, at which a term is generalised or removed.

    ``support``: distinct lines in which a term and an entity must meet; ``shortest``: letters of a term.
    """

    generalise: float = 0.8
    remove: float = 0.95
    support: int = 2
    shortest: int = 3


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Of up to 19 digits: from the right every second one is doubled, its digits added; the sum divides by 10."""

    def add(total: Column, k: Column) -> Column:
        d = F.substr(digits, F.length(digits) - k, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(k % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def is_valid(kind: Column, value: Column) -> Column:
    n = F.length(_digits(value))
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", value.rlike(_IP))
        .when(kind == "card", F.when(n.between(12, 19), luhn(_digits(value))).otherwise(False))
        .otherwise(n.between(9, 15))
    )


def matches(text: Column, kinds: tuple[str, ...] = KINDS[:4], patterns: dict[str, str] = PATTERNS) -> Column:
    """Array of (kind, i, before, value): every match of every kind, and how many characters lie between it and the one before."""
    guards = {"email": text.contains("@"), "phone": text.contains("+")}
    none = F.array().cast("array<struct<kind:string,i:int,before:int,value:string>>")
    return F.concat(*[F.when(guards.get(k, text.rlike("[0-9]")), _numbered(text, k, patterns[k])).otherwise(none) for k in kinds])


def _numbered(text: Column, kind: str, pattern: str) -> Column:
    """A text splits into one piece more than it has matches: piece i lies before match i."""
    zipped = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"),
        F.transform(F.split(text, pattern, -1), lambda piece: F.length(piece)).alias("before"),
    )
    numbered = F.transform(
        zipped, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), x["before"].alias("before"), x["value"].alias("value"))
    )
    return F.filter(numbered, lambda x: x["value"].isNotNull())


def _placed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """start and end of each exploded match ``m``: running sums over the matches of a text."""
    run = Window.partitionBy(*keys, "m.kind").orderBy("m.i")
    end = F.sum(F.col("m.before") + F.length("m.value")).over(run)
    return rows.withColumn("end", end.cast("long")).withColumn("start", F.col("end") - F.length("m.value"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _kind_number(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind).cast("int")


def _span(kind: Column, start: Column, end: Column, value: Column) -> Column:
    """Sorts by start, then kind as listed."""
    return F.struct(start.alias("start"), _kind_number(kind).alias("rank"), kind.alias("kind"), end.alias("end"), value.alias("value"))


def disclosing(lines: DataFrame, all_lines: DataFrame, n_lines: int, s: Settings) -> DataFrame:
    """(entity, term, strength) for terms that reveal an entity enough to be changed.

    ``lines``: uid, line, text, entity. The unit is the line. With p(e) the share of
    lines that hold entity e, and p(e|t) the share of term t's lines that do,
    t reveals log(p(e|t) / p(e)) of the -log p(e) that e is worth:
    strength = 1 + log p(e|t) / -log p(e), which is 1 if t never occurs without e.
    """
    blank = F.col("text")
    for pattern in (PATTERNS["email"], PATTERNS["ip"], _LONG_NUMBER, PATTERNS["phone"]):
        blank = F.regexp_replace(blank, F.lit(pattern), F.lit(" "))
    terms = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(blank), F.lit(TERM), F.lit(0)), lambda t: F.length(t) >= s.shortest))
    entity_lines = lines.select("uid", "line", "entity", F.xxhash64("text").alias("same"), terms.alias("terms")).distinct()
    by_entity = entity_lines.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    pairs = entity_lines.select("entity", "same", F.explode("terms").alias("term"))
    # first per distinct line, so that copies of a line are one row, then per pair
    met = pairs.groupBy("entity", "term", "same").agg(F.count(F.lit(1)).alias("n")).groupBy("entity", "term").agg(
        F.sum("n").alias("n_et"), F.count(F.lit(1)).alias("support")
    )
    met = stored(met.where(F.col("support") >= s.support), "pii-met")
    wanted = stored(met.select("term").distinct(), "pii-terms")
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))
    counts = all_lines.select(F.explode(words).alias("term")).where(F.length("term") >= s.shortest).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    counts = stored(counts.join(wanted, "term"), "pii-term-counts")
    shares = met.join(counts, "term").join(stored(by_entity.where(F.col("n_e") >= s.support), "pii-entities"), "entity")
    worth = -F.log(F.col("n_e") / F.lit(float(max(n_lines, 1))))
    strength = F.when(worth > 0, 1 + F.log(F.col("n_et") / F.greatest("n_t", "n_et")) / worth).otherwise(F.lit(0.0))
    return stored(shares.select("entity", "term", strength.alias("strength")).where(F.col("strength") >= s.generalise), "pii-disclosing")


def found_spans(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """One row per input row: id, base (spans of the patterns), all (with the terms'), text (null unless kept or spans are near).

    A span is (start, rank, kind, end, value), in code points, end exclusive; arrays are sorted by start, then kind.

    1. One scan matches all patterns; a written table keeps each row's matches, and the text only where there are any.
    2. Lines with an entity (a valid match, lower-cased or digits only) give the terms that meet it; terms of all
       lines are counted with partial sums before the shuffle; strengths follow (``disclosing``).
    3. A term with a strength of at least ``generalise`` is a span wherever it shares a line with its entity,
       outside the patterns' spans.

    Null and empty texts have no spans. Repeated rows, also of one id, are rows of
    their own. A null id stays null. Extra columns are ignored. An empty table
    gives no rows. An entity in a third of all lines is counted by partial sums
    and joined from written tables, which Spark splits when they are skewed.
    """
    s = settings
    source = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    found = source.withColumn("matches", matches(F.col("text"))).withColumn("n_lines", F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1)
    kept = F.col("text") if keep_text else F.when(F.size("matches") > 0, F.col("text"))
    found = stored(found.select("uid", "id", "matches", "n_lines", kept.alias("text")), "pii-found")
    placed = _placed(found.where(F.size("matches") > 0).select("uid", F.explode("matches").alias("m")), ["uid"])
    valid = placed.where(is_valid(F.col("m.kind"), F.col("m.value")))
    spans = valid.groupBy("uid").agg(
        F.sort_array(F.collect_list(_span(F.col("m.kind"), F.col("start"), F.col("end"), F.col("m.value")))).alias("base")
    )
    spans = stored(spans, "pii-spans")
    with_text = found.where(F.size("matches") > 0).select("uid", "text").join(spans, "uid")
    newline = F.split("text", "\n", -1)
    lines = with_text.select("uid", "base", F.posexplode(newline).alias("line", "part"))
    upto = Window.partitionBy("uid").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("begin", F.coalesce(F.sum(F.length("part") + 1).over(upto), F.lit(0)).cast("long"))
    finish = F.col("begin") + F.length("part")
    inside = F.filter("base", lambda x: (x["start"] >= F.col("begin")) & (x["start"] < finish))
    lines = stored(lines.withColumn("inside", inside).where(F.size("inside") > 0).select("uid", "line", "begin", "part", "inside"), "pii-lines")
    value = F.col("x.value")
    entity = F.concat(F.col("x.kind"), F.lit(":"), F.when(F.col("x.kind") == "email", F.lower(value)).when(F.col("x.kind") == "ip", value).otherwise(_digits(value)))
    entities = stored(
        lines.select("uid", "line", F.col("part").alias("text"), F.explode("inside").alias("x")).select("uid", "line", "text", entity.alias("entity")).distinct(),
        "pii-entity-lines",
    )
    n_lines = found.agg(F.coalesce(F.sum("n_lines"), F.lit(0))).first()[0]
    all_lines = docs.select(F.explode(F.split(text_or_empty(text_col), "\n", -1)).alias("text"))
    telling = disclosing(entities, all_lines, int(n_lines), s)
    flagged = stored(
        entities.select("uid", "line", "entity").join(telling, "entity").groupBy("uid", "line", "term").agg(F.max("strength").alias("strength")), "pii-flagged"
    )
    flagged_lines = lines.join(flagged.select("uid", "line").distinct(), ["uid", "line"])
    words = _placed(
        flagged_lines.select("uid", "line", "begin", "inside", F.explode(_numbered(F.col("part"), "term", TERM)).alias("m")), ["uid", "line"]
    ).withColumn("term", F.lower("m.value"))
    words = words.join(flagged, ["uid", "line", "term"])
    start, end = F.col("begin") + F.col("start"), F.col("begin") + F.col("end")
    outside = ~F.exists("inside", lambda x: (x["start"] < end) & (x["end"] > start))
    terms = words.where(outside).groupBy("uid").agg(
        F.sort_array(F.collect_list(_span(F.lit("term"), start, end, F.when(F.col("strength") >= s.remove, F.lit("")).otherwise(F.lit("[TERM]"))))).alias("terms")
    )
    empty = F.array().cast(spans.schema["base"].dataType)
    out = found.select("uid", "id", "text").join(spans, "uid", "left").join(stored(terms, "pii-term-spans"), "uid", "left")
    base, extra = F.coalesce("base", empty), F.coalesce("terms", empty)
    return out.select(F.col("id").alias(id_col), base.alias("base"), F.sort_array(F.concat(base, extra)).alias("all"), "text")


def _of_kind(kind: str):
    return lambda x: x["kind"] == kind


def report(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    spans = found_spans(docs, settings, id_col, text_col)
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS[:4]]
    return spans.select(F.col(id_col), *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"))


def sanitised(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and text with personal data replaced by its kind, and telling terms by "[TERM]" or nothing.

    Where spans overlap, the one that begins first is replaced and the others' remainder goes with it.
    """
    spans = found_spans(docs, settings, id_col, text_col, keep_text=True)
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    text = F.col("text")

    def step(acc: Column, x: Column) -> Column:
        mark = F.when(x["kind"] == "term", x["value"]).otherwise(F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))
        between = F.substr(text, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int"))
        later = F.struct(F.greatest(acc["at"], x["end"]).alias("at"), acc["out"].alias("out"))
        replaced = F.struct(x["end"].alias("at"), F.concat(acc["out"], between, mark).alias("out"))
        return F.when(x["start"] >= acc["at"], replaced).otherwise(later)

    done = F.aggregate("all", zero, step, lambda acc: F.concat(acc["out"], F.substr(text, (acc["at"] + 1).cast("int"), F.length(text))))
    return spans.select(F.col(id_col), F.when(F.size("all") > 0, done).otherwise(text).alias(text_col))
