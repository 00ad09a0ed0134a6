"""Text column expressions (all JVM-side, no Python UDF).

Whitespace contract: Python's ``strip``/``split`` cover every Unicode space;
here ``\\s`` (ASCII space, tab, CR, LF, FF) is the portable class that Spark
(Java regex) and DuckDB (RE2) agree on.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English stop words (the standard NLTK English list, 179 words).
STOP_WORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves "
    "he him his himself she she's her hers herself it it's its itself they them their theirs themselves "
    "what which who whom this that that'll these those am is are was were be been being have has had having "
    "do does did doing a an the and but if or because as until while of at by for with about against between "
    "into through during before after above below to from up down in out on off over under again further then "
    "once here there when where why how all any both each few more most other some such no nor not only own "
    "same so than too very s t can will just don don't should should've now d ll m o re ve y ain aren aren't "
    "couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn "
    "mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't "
    "wouldn wouldn't"
).split()

# Extra words dropped from report text before TF-IDF.
DOMAIN_WORDS = [
    "principal", "activities", "investment", "holding", "holdings", "singapore",
    "exchange", "securities", "trading", "limited", "company",
]

# ASCII punctuation and digits as one character class: code points 33-64
# (punctuation and 0-9), 91-96 and 123-126. Removing both in one pass equals
# removing punctuation and then digit runs (both only delete characters).
PUNCT_AND_DIGITS_RE = r"[!-@\[-`{-~]+"

# Ordered business-activity patterns; the first that matches wins.
BUSINESS_PATTERNS = [
    ("food & beverages", r"\b(food|beverage)\b"),
    ("insurance", r"\b(insurance)\b"),
    ("information technology", r"\b(it|technology)\b"),
    ("telecommunications", r"\b(telecommunication|telecom)\b"),
    ("motor vehicle manufacturing", r"\b(motor vehicle|automotive)\b"),
    ("real estate", r"\b(real estate)\b"),
    ("retail", r"\b(retail)\b"),
    ("healthcare", r"\b(healthcare|medical)\b"),
    ("financial services", r"\b(financial services|banking)\b"),
    ("energy and utilities", r"\b(energy|utilities)\b"),
    ("construction and engineering", r"\b(construction|engineering)\b"),
    ("transportation and logistics", r"\b(transportation|logistics)\b"),
    ("media and entertainment", r"\b(media|entertainment)\b"),
    ("hospitality and tourism", r"\b(hospitality|tourism)\b"),
    ("education and training", r"\b(education|training)\b"),
]
OTHER_ACTIVITY = "Other"

# Placeholders that mean "missing" in the source tables.
BLANK_MARKERS = ["<Blank>", "NaN"]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Remove leading/trailing whitespace (``\\s`` class)."""
    return F.regexp_replace(_c(c), r"^\s+|\s+$", "")


def blank_to_empty(c) -> Column:
    """'<Blank>', 'NaN' and null -> ''."""
    c = _c(c)
    return F.when(c.isNull() | c.isin(*BLANK_MARKERS), F.lit("")).otherwise(c)


def normalize_text(c) -> Column:
    """strip, CRLF and LF -> space, lower case."""
    s = strip_ws(c)
    s = F.replace(s, F.lit("\r\n"), F.lit(" "))
    s = F.replace(s, F.lit("\n"), F.lit(" "))
    return F.lower(s)


def clean_text(c, lower: bool = False) -> Column:
    """newline -> space, bullet -> '- ', collapse whitespace runs, strip."""
    s = F.replace(_c(c), F.lit("\n"), F.lit(" "))
    s = F.replace(s, F.lit("•"), F.lit("- "))
    if lower:
        s = F.lower(s)
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def strip_trailing_dot(c) -> Column:
    """Remove one final '.'."""
    return F.regexp_replace(_c(c), r"\.\z", "")


def build_description(title, definition, examples) -> Column:
    """title + '.' + definition + '.' + examples (null in, null out)."""
    return F.concat(_c(title), F.lit("."), _c(definition), F.lit("."), _c(examples))


def tokenize_words(c, letters: str = "ascii") -> Column:
    """Lower-cased word tokens. ``ascii`` splits on [^a-z]+; ``unicode`` on
    non-letters (\\p{L}); empty tokens are dropped."""
    pattern = "[^a-z]+" if letters == "ascii" else r"[^\p{L}]+"
    return F.filter(F.split(F.lower(_c(c)), pattern), lambda t: t != "")


def _drop_words(tokens: Column, words: list[str]) -> Column:
    # ``isin`` over many literals is planned as a hash set (InSet): O(1) per token
    return F.filter(tokens, lambda t: (t != "") & ~t.isin(*words))


def bind_once(c, fn) -> Column:
    """Evaluate ``fn`` on one evaluation of ``c``.

    A filter that names a computed column several times is pushed below the
    projection with the column's expression inlined at every reference, so an
    expensive expression (a regex chain over a whole page) would run once per
    reference. Binding it to a lambda variable evaluates it once.
    """
    return F.exists(F.array(_c(c)), fn)


def let(c, fn) -> Column:
    """``fn`` of one evaluation of ``c``: a value that ``fn`` names several times is not computed again for each."""
    return F.get(F.transform(F.array(_c(c)), fn), F.lit(0))


def preprocess_tags(c) -> Column:
    """Strip tags, keep ASCII letters and whitespace, lower, drop stop words."""
    s = F.regexp_replace(_c(c), "<.*?>", " ")
    s = F.regexp_replace(s, r"[^a-zA-Z\s]", "")
    s = F.lower(s)
    return F.array_join(_drop_words(F.split(s, r"\s+"), STOP_WORDS), " ")


def preprocess_domain(c, extra_words: list[str] | None = None) -> Column:
    """lower, drop punctuation and digits, drop stop words and domain words."""
    s = F.regexp_replace(F.lower(_c(c)), PUNCT_AND_DIGITS_RE, "")
    words = STOP_WORDS + (DOMAIN_WORDS if extra_words is None else extra_words)
    return F.array_join(_drop_words(F.split(s, r"\s+"), words), " ")


def tag_activity(c, patterns=BUSINESS_PATTERNS, other: str = OTHER_ACTIVITY) -> Column:
    """First activity whose pattern matches the (cleaned, ASCII) text."""
    c = _c(c)
    expr = None
    for activity, pattern in patterns:
        cond = c.rlike(pattern)
        expr = F.when(cond, F.lit(activity)) if expr is None else expr.when(cond, F.lit(activity))
    return expr.otherwise(F.lit(other))


def is_junk_text(c, literal_nan: bool = False) -> Column:
    """True for text to drop: shorter than 4 chars (null counts as 'nan'),
    or containing '403' / '404 not found' / the word 'nan' (case-insensitive).

    ``literal_nan=True`` uses the substring rule, which also drops 'finance'.
    """

    return bind_once(c, lambda t: junk_rule(t, literal_nan))


def junk_rule(t: Column, literal_nan: bool = False) -> Column:
    low = F.lower(t)
    nan_hit = low.contains("nan") if literal_nan else low.rlike(r"(^|[^a-z0-9_])nan([^a-z0-9_]|$)")
    return t.isNull() | (F.length(t) < 4) | low.contains("403") | low.contains("404 not found") | nan_hit


def kept_value(c, keep, then=None) -> Column:
    """Generator column: ``then(value)`` (or the value) of ``c`` when
    ``keep(value)`` holds, else no row. Use in ``select`` as a filter that
    evaluates ``c`` exactly once (a plain ``where`` on a computed column
    re-evaluates it in the pushed predicate)."""
    kept = F.filter(F.array(_c(c)), keep)
    return F.explode(F.transform(kept, then) if then is not None else kept)


def company_from_filename(c) -> Column:
    """Report file name -> company: with an extension, drop it, join the
    remaining dot-parts with spaces, drop the last 5 chars, strip; without
    one, drop the last 9 chars and strip."""
    c = _c(c)
    stem = F.replace(F.regexp_replace(c, r"\.[^.]*\z", ""), F.lit("."), F.lit(" "))
    with_ext = strip_ws(F.substring(stem, F.lit(1), F.greatest(F.length(stem) - 5, F.lit(0))))
    no_ext = strip_ws(F.substring(c, F.lit(1), F.greatest(F.length(c) - 9, F.lit(0))))
    return F.when(c.contains("."), with_ext).otherwise(no_ext)


def company_from_spaced_filename(c) -> Column:
    """The variant for names whose last word is the file's: with a '.', drop the
    last space-separated word, then the last 5 chars, strip; without one, drop the last
    9 chars and strip. One trailing '.' goes."""
    c = _c(c)
    words = F.split(c, " ", -1)
    stem = F.array_join(F.slice(words, 1, F.size(words) - 1), " ")
    with_dot = strip_ws(F.substring(stem, F.lit(1), F.greatest(F.length(stem) - 5, F.lit(0))))
    without = strip_ws(F.substring(c, F.lit(1), F.greatest(F.length(c) - 9, F.lit(0))))
    return F.regexp_replace(F.when(c.contains("."), with_dot).otherwise(without), r"\.\z", "")


# Profile and search URL formats.
PROFILE_URL = "https://www.linkedin.com/company/{}/about"
SEARCH_URL = "https://www.linkedin.com/search/results/companies/?keywords={}"


def query_url(c, template: str = PROFILE_URL, dash_spaces: bool = False) -> Column:
    """Company name -> profile or search URL; the older form puts '-' for spaces."""
    name = F.replace(_c(c), F.lit(" "), F.lit("-")) if dash_spaces else _c(c)
    head, tail = template.split("{}")
    return F.concat(F.lit(head), name, F.lit(tail))
