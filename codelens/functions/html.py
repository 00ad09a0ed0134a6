"""HTML and URL column expressions: regex chains instead of a parser.

Contract (checked against SQL and against hand-made pages): script and style
elements go first, up to the end of the page if they are never closed (a page
may hold '</p>' inside a script), then comments and declarations; every tag
becomes a space, where a quoted attribute may hold '>'; space runs collapse to
one space (a choice of this library: the original keeps them); all named,
decimal and hexadecimal entities that end in ';' are decoded, once; '\\n', '>'
and '|' are removed (which joins neighbouring words, as the original does); the
result is stripped and empty text becomes null.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from codelens.functions.text import let, strip_ws

ENTITY_RE = r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]*);"


def named_entities() -> dict[str, str]:
    """'&amp;' -> '&' and so on: the HTML standard's list (from the standard
    library), frequent names first, and the numbers that stand for Windows-1252."""
    first = ["amp;", "lt;", "gt;", "quot;", "nbsp;", "copy;", "middot;"]
    names = first + sorted(n for n in html5 if n.endswith(";") and n not in first)
    out = {f"&{n}": html5[n] for n in names}
    for code in range(0x80, 0xA0):
        try:
            out[f"&#{code};"] = bytes([code]).decode("cp1252")
        except UnicodeDecodeError:
            pass
    return out


# Strings removed from extracted text.
REMOVE_STRINGS = ["\n", ">", "|"]
# Keywords that mark an "about the company" link.
LINK_KEYWORDS = ["about", "profile"]

SCRIPT_RE = r"(?is)<script\b.*?(?:</script\s*>|\z)"
STYLE_RE = r"(?is)<style\b.*?(?:</style\s*>|\z)"
COMMENT_RE = r"(?s)<!--.*?-->"
DOCTYPE_RE = r"(?i)<![a-z][^>]*>"
# quoted attribute values may hold '>'; the second form is for unbalanced quotes
TAG_RE = r"""</?[A-Za-z](?:[^>"']+|"[^"]*"|'[^']*')*>|</?[A-Za-z][^>]*>"""
# other attributes are stepped over whole, so neither data-href nor a value counts
HREF_RE = (
    r"""(?i)<a(?:\s+[^\s=>"'/]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?)*?"""
    r"""\s+href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
)
QUOTES_RE = r"""^["']|["']$"""


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _sql_string(s: str) -> str:
    return "'" + "".join(c if c.isalnum() or c in "&#;" or ord(c) > 0xFFFF else f"\\u{ord(c):04X}" for c in s) + "'"


def _entity_map() -> Column:
    return F.expr("map(" + ", ".join(f"{_sql_string(k)}, {_sql_string(v)}" for k, v in named_entities().items()) + ")")


def decode_entities(c) -> Column:
    """Named, decimal and hexadecimal entities, each once; unknown names stay.

    The input is bound once: a chain of replacements over a page, named three
    times here, would run three times.
    """
    names = _entity_map()

    def decoded(x: Column) -> Column:
        digits = F.regexp_replace(x, "[&#xX;]", "")
        code = F.when(x.rlike("^&#[0-9]"), digits.try_cast("bigint")).when(x.startswith("&#"), F.conv(digits, 16, 10).try_cast("bigint"))
        known = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(known, code).otherwise(0xFFFD)), 8, "0")), "UTF-32")
        return F.coalesce(names[x], F.when(code.isNotNull(), char), x)

    def replaced(s: Column) -> Column:
        found = F.transform(F.regexp_extract_all(s, F.lit(ENTITY_RE), 0), decoded)
        pieces = F.split(s, ENTITY_RE, -1)
        joined = F.array_join(F.zip_with(pieces, found, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
        return F.when(s.contains("&"), joined).otherwise(s)

    return let(c, replaced)


def html_to_text(c) -> Column:
    s = _c(c)
    for pat in (SCRIPT_RE, STYLE_RE, COMMENT_RE, DOCTYPE_RE):
        s = F.regexp_replace(s, pat, "")
    s = F.regexp_replace(s, TAG_RE, " ")
    s = F.regexp_replace(s, " {2,}", " ")
    s = decode_entities(s)
    for r in REMOVE_STRINGS:
        s = F.replace(s, F.lit(r), F.lit(""))
    return let(strip_ws(s), lambda t: F.when(t != "", t))


def extract_links(c) -> Column:
    """All anchor hrefs (quoted or not), entity-decoded, in page order."""
    found = F.regexp_extract_all(_c(c), F.lit(HREF_RE), 1)
    return F.transform(found, lambda x: decode_entities(F.regexp_replace(x, QUOTES_RE, "")))


def filter_links(links, keywords=LINK_KEYWORDS) -> Column:
    """Links whose lower case contains any keyword; distinct and sorted."""

    def hit(x):
        cond = None
        for k in keywords:
            h = F.lower(x).contains(k)
            cond = h if cond is None else (cond | h)
        return cond

    return F.array_sort(F.array_distinct(F.filter(_c(links), hit)))


def resolve_links(links, site) -> Column:
    """Relative link -> site + ('/' if missing) + link; absolute kept."""
    site = _c(site)

    def fix(x):
        rel = F.when(x.startswith("/"), x).otherwise(F.concat(F.lit("/"), x))
        return F.when(x.startswith("http"), x).otherwise(F.concat(site, rel))

    return F.transform(_c(links), fix)


def site_and_links(site, links) -> Column:
    """[site] (if not null) + links; explode with ``explode_outer``."""
    return F.concat(F.array_compact(F.array(_c(site))), F.coalesce(_c(links), F.array().cast("array<string>")))


def force_https(c) -> Column:
    c = _c(c)
    return (
        F.when(c.startswith("https://"), c)
        .when(c.startswith("http://"), F.replace(c, F.lit("http://"), F.lit("https://")))
        .otherwise(F.concat(F.lit("https://"), c))
    )


def site_root(c) -> Column:
    """scheme://host of a URL; null for a URL without a scheme."""
    return F.nullif(F.regexp_extract(_c(c), r"^(https?://[^/?#]+)", 1), F.lit(""))


def open_tag_re(tag: str, css_class: str | None) -> str:
    if not css_class:
        return rf"<{tag}\b[^>]*>"
    inside = rf"(?:[^\"']*\s)?{css_class}(?:\s[^\"']*)?"
    return rf"<{tag}\s(?:[^>]*\s)?class\s*=\s*(?:\"{inside}\"|'{inside}')[^>]*>"


def first_tag_text(c, tag: str, css_class: str | None = None, must_contain: str | None = None) -> Column:
    """Text of the first ``<tag class="... css_class ...">`` element (tags
    inside it stripped, stripped of whitespace); '' when absent. ``css_class``
    is matched by whole class names. With ``must_contain`` the first element
    whose text contains it."""
    pat = rf"(?is){open_tag_re(tag, css_class)}(.*?)</{tag}\s*>"
    items = F.transform(
        F.regexp_extract_all(_c(c), F.lit(pat), 1),
        lambda x: strip_ws(decode_entities(F.regexp_replace(x, TAG_RE, ""))),
    )
    if must_contain:
        items = F.filter(items, lambda x: x.contains(must_contain))
    return F.coalesce(F.get(items, 0), F.lit(""))


# Where the profile fields sit on a company profile page
# (tag, class attribute, required text).
PROFILE_FIELDS = {
    "category": ("div", "org-top-card-summary-info-list__info-item", None),
    "website": ("span", "link-without-visited-state", "http"),
    "text": ("p", "break-words white-space-pre-wrap t-black--light text-body-medium", None),
}


def profile_fields(c, fields=PROFILE_FIELDS) -> dict[str, Column]:
    """Category, website and description of a profile page ('' when absent)."""
    return {name: first_tag_text(c, tag, cls, must) for name, (tag, cls, must) in fields.items()}
