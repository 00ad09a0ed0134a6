"""Independent SQL (DuckDB dialect) for every deterministic query.

The fixture views of ``codelens.sources.fixtures`` are restated here as CTEs
over the raw tables, so each oracle string runs on the driver's pre-registered
parquet views alone.
"""

from __future__ import annotations

# name -> (dependencies, SELECT body)
FIXTURE_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "dict_sub": ((), """
        SELECT code, title, CAST(NULL AS VARCHAR) AS groups, definition, examples FROM (
          SELECT lpad(CAST((p_partkey * 37) % 100000 AS VARCHAR), 5, '0') AS code,
                 p_name AS title,
                 p_type || ':' || chr(10) || '•' || p_name || chr(10) || '•' || p_brand AS definition,
                 CASE WHEN p_partkey % 7 = 0 THEN '<Blank>' ELSE p_brand END AS examples,
                 row_number() OVER (PARTITION BY (p_partkey * 37) % 100000 ORDER BY p_partkey) AS rn
          FROM part) s WHERE rn = 1"""),
    "dictionary": (("dict_sub",), """
        SELECT s AS code, 'Section ' || s AS title,
               string_agg('•' || d || ' Division ' || d, chr(10) ORDER BY d) AS groups,
               CAST(NULL AS VARCHAR) AS definition, CAST(NULL AS VARCHAR) AS examples
        FROM (SELECT DISTINCT chr(65 + CAST(floor(CAST(substr(code, 1, 2) AS INTEGER) / 5) AS INTEGER)) AS s,
                              substr(code, 1, 2) AS d FROM dict_sub) x GROUP BY s
        UNION ALL
        SELECT d, 'Division ' || d, string_agg('•' || g || ' Group ' || g, chr(10) ORDER BY g), NULL, NULL
        FROM (SELECT DISTINCT substr(code, 1, 2) AS d, substr(code, 1, 3) AS g FROM dict_sub) x GROUP BY d
        UNION ALL
        SELECT g, 'Group ' || g, NULL, NULL, NULL FROM (SELECT DISTINCT substr(code, 1, 3) AS g FROM dict_sub) x
        UNION ALL
        SELECT c, 'Class ' || c, NULL, NULL, NULL FROM (SELECT DISTINCT substr(code, 1, 4) AS c FROM dict_sub) x
        UNION ALL
        SELECT code, title, groups, definition, examples FROM dict_sub"""),
    "index_entries": ((), """
        SELECT lpad(CAST((p_partkey * 37) % 100000 AS VARCHAR), 5, '0') AS code, 'index entry ' || p_name AS definition FROM part"""),
    "truth": ((), """
        SELECT CAST(c_custkey AS VARCHAR) AS uen,
               CASE WHEN c_custkey % 8 = 0 THEN c_name || '.' ELSE c_name END AS company,
               lpad(CAST((c_custkey * 37) % 100000 AS VARCHAR), 5, '0') AS ssic_code,
               CASE WHEN c_custkey % 4 = 0 THEN NULL
                    ELSE lpad(CAST(((c_custkey + 1) * 37) % 100000 AS VARCHAR), 5, '0') END AS ssic_code2
        FROM customer"""),
    "company_text": ((), """
        SELECT d.doc_id,
               CASE WHEN c.c_name IS NULL THEN 'Company#' || CAST(d.doc_id AS VARCHAR)
                    WHEN d.doc_id % 10 = 9 THEN c.c_name || ' Holdings'
                    ELSE c.c_name END AS company,
               d.text, d.lang
        FROM documents d LEFT JOIN customer c ON d.doc_id = c.c_custkey"""),
    "page_text": ((), """
        SELECT p.page_id,
               coalesce(c.c_name, 'Company#' || CAST(CAST(floor(p.page_id / 2) AS BIGINT) AS VARCHAR)) AS company,
               p.url, p.html,
               CASE WHEN p.page_id % 2 = 0 THEN 'main' ELSE 'sub' END AS kind,
               CAST(p.page_id % 2 AS INTEGER) AS ord
        FROM pages p LEFT JOIN customer c ON CAST(floor(p.page_id / 2) AS BIGINT) = c.c_custkey"""),
    "vectors": ((), """
        SELECT vec_id, embedding, label AS primary_code,
               CASE WHEN vec_id % 4 = 0 THEN NULL ELSE CAST((label + 3) % 10 AS INTEGER) END AS secondary_code
        FROM embeddings"""),
}


def _closure(names) -> list[str]:
    out: list[str] = []

    def visit(n):
        if n in out:
            return
        for d in FIXTURE_SQL[n][0]:
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def with_views(views, *ctes: tuple[str, str], body: str) -> str:
    """``WITH <fixture views> , <extra ctes> <body>``."""
    parts = [f"{n} AS ({FIXTURE_SQL[n][1]})" for n in _closure(views)]
    parts += [f"{n} AS ({sql})" for n, sql in ctes]
    head = ("WITH " + ",\n".join(parts) + "\n") if parts else ""
    return head + body


def bucket_sql(key: str, seed=None, buckets: int = 100) -> str:
    """md5 bucket; equals ``codelens.operators.split.hash_bucket``."""
    k = f"CAST({key} AS VARCHAR)"
    if seed is not None:
        k = f"({k} || '#{seed}')"
    return f"CAST(CAST(('0x' || substr(md5({k}), 1, 7)) AS BIGINT) % {buckets} AS INTEGER)"


def exp_score_sql(rank: str, code: str, declared: str, top_n: int) -> str:
    return (
        f"CASE WHEN {rank} <= {top_n} AND {code} = {declared} THEN "
        f"(CASE WHEN {rank} = 1 THEN CAST(0 AS DOUBLE) ELSE round(1 - pow(CAST(0.9 AS DOUBLE), {rank} - 1), 2) END) "
        f"ELSE CAST(1 AS DOUBLE) END"
    )


def linear_score_sql(rank: str, code: str, declared: str, top_n: int) -> str:
    return (
        f"CASE WHEN {rank} <= {top_n} AND {code} = {declared} THEN "
        f"(CASE WHEN {rank} = 1 THEN CAST(0 AS DOUBLE) ELSE round(({rank} - 1) / CAST({top_n} AS DOUBLE), 2) END) "
        f"ELSE CAST(1 AS DOUBLE) END"
    )


def cosine_sql(a: str, b: str) -> str:
    return (
        f"round(list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))), 6)"
    )


def total_score_sql(s1: str, s2: str) -> str:
    return (
        f"round(({s1} * 1.0 + coalesce({s2}, 0) * 0.5) / "
        f"(1.0 + CASE WHEN {s2} IS NOT NULL THEN 0.5 ELSE 0 END), 2)"
    )


# ---- text expressions restated in DuckDB SQL ------------------------------------

def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(words) -> str:
    return "[" + ", ".join(sql_str(w) for w in words) + "]"


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def normalize_sql(c: str) -> str:
    return f"lower(replace(replace({strip_sql(c)}, chr(13) || chr(10), ' '), chr(10), ' '))"


def clean_sql(c: str, lower: bool = False) -> str:
    s = f"replace(replace({c}, chr(10), ' '), '•', '- ')"
    if lower:
        s = f"lower({s})"
    return f"trim(regexp_replace({s}, '\\s+', ' ', 'g'))"


def drop_words_sql(arr: str, words) -> str:
    return f"list_filter({arr}, lambda t: t <> '' AND NOT list_contains({sql_list(words)}, t))"


def preprocess_tags_sql(c: str) -> str:
    from codelens.functions.text import STOP_WORDS

    s = f"lower(regexp_replace(regexp_replace({c}, '<.*?>', ' ', 'g'), '[^a-zA-Z\\s]', '', 'g'))"
    return f"array_to_string({drop_words_sql(f'regexp_split_to_array({s}, ' + sql_str(chr(92) + 's+') + ')', STOP_WORDS)}, ' ')"


def preprocess_domain_sql(c: str) -> str:
    from codelens.functions.text import DOMAIN_WORDS, PUNCT_AND_DIGITS_RE, STOP_WORDS

    s = f"regexp_replace(lower({c}), {sql_str(PUNCT_AND_DIGITS_RE)}, '', 'g')"
    arr = f"regexp_split_to_array({s}, '\\s+')"
    return f"array_to_string({drop_words_sql(arr, STOP_WORDS + DOMAIN_WORDS)}, ' ')"


def tokenize_sql(c: str, letters: str = "ascii") -> str:
    pat = "[^a-z]+" if letters == "ascii" else "[^\\p{L}]+"
    return f"list_filter(regexp_split_to_array(lower({c}), '{pat}'), lambda t: t <> '')"


def tag_activity_sql(c: str, patterns) -> str:
    from codelens.functions.text import OTHER_ACTIVITY

    whens = " ".join(f"WHEN regexp_matches({c}, {sql_str(p)}) THEN {sql_str(a)}" for a, p in patterns)
    return f"CASE {whens} ELSE {sql_str(OTHER_ACTIVITY)} END"


def junk_sql(c: str, literal_nan: bool = False) -> str:
    nan = f"contains(lower({c}), 'nan')" if literal_nan else f"regexp_matches(lower({c}), '(^|[^a-z0-9_])nan([^a-z0-9_]|$)')"
    return (f"({c} IS NULL OR length({c}) < 4 OR contains(lower({c}), '403') "
            f"OR contains(lower({c}), '404 not found') OR {nan})")


def decode_entities_sql(c: str) -> str:
    """The standard list comes from the standard library on both sides; numbers are decoded by DuckDB's chr()."""
    from codelens.functions.html import ENTITY_RE, named_entities

    names = ", ".join(f"{sql_str(k)}: {sql_str(v)}" for k, v in named_entities().items())
    number = ("CASE WHEN regexp_matches(e, '^&#[0-9]') THEN TRY_CAST(substr(e, 3, length(e) - 3) AS BIGINT) "
              "WHEN starts_with(e, '&#') THEN TRY_CAST('0x' || substr(e, 4, length(e) - 4) AS BIGINT) END")
    valid = "list_filter([{n}], lambda k: k BETWEEN 1 AND 55295 OR k BETWEEN 57344 AND 1114111)[1]".format(n=number)
    one = (f"coalesce(MAP {{{names}}}[e], CASE WHEN starts_with(e, '&#') THEN chr(CAST(coalesce({valid}, 65533) AS INTEGER)) END, e)")
    pieces = f"regexp_split_to_array({c}, {sql_str(ENTITY_RE)})"
    found = f"list_transform(regexp_extract_all({c}, {sql_str(ENTITY_RE)}), lambda e: {one})"
    return (f"CASE WHEN contains({c}, '&') THEN list_aggregate(list_transform(list_zip({pieces}, {found}), "
            f"lambda z: coalesce(z[1], '') || coalesce(z[2], '')), 'string_agg', '') ELSE {c} END")


def html_to_text_sql(c: str) -> str:
    from codelens.functions.html import COMMENT_RE, DOCTYPE_RE, REMOVE_STRINGS, SCRIPT_RE, STYLE_RE, TAG_RE

    s = c
    for pat in (SCRIPT_RE, STYLE_RE, COMMENT_RE, DOCTYPE_RE):
        s = f"regexp_replace({s}, {sql_str(pat)}, '', 'g')"
    s = f"regexp_replace({s}, {sql_str(TAG_RE)}, ' ', 'g')"
    s = f"regexp_replace({s}, ' {{2,}}', ' ', 'g')"
    s = decode_entities_sql(s)
    for r in REMOVE_STRINGS:
        s = f"replace({s}, {sql_str(r) if r != chr(10) else 'chr(10)'}, '')"
    return f"nullif({strip_sql(s)}, '')"


def extract_links_sql(c: str) -> str:
    from codelens.functions.html import HREF_RE, QUOTES_RE

    bare = f"list_transform(regexp_extract_all({c}, {sql_str(HREF_RE)}, 1), lambda q: regexp_replace(q, {sql_str(QUOTES_RE)}, '', 'g'))"
    return f"list_transform({bare}, lambda x: {decode_entities_sql('x')})"


def filter_links_sql(arr: str, keywords) -> str:
    cond = " OR ".join(f"contains(lower(x), {sql_str(k)})" for k in keywords)
    return f"list_sort(list_distinct(list_filter({arr}, lambda x: {cond})))"


def site_root_sql(c: str) -> str:
    return f"nullif(regexp_extract({c}, '^(https?://[^/?#]+)', 1), '')"


def resolve_links_sql(arr: str, site: str) -> str:
    return (f"list_transform({arr}, lambda x: CASE WHEN starts_with(x, 'http') THEN x "
            f"ELSE {site} || CASE WHEN starts_with(x, '/') THEN x ELSE '/' || x END END)")


def force_https_sql(c: str) -> str:
    return (f"CASE WHEN starts_with({c}, 'https://') THEN {c} WHEN starts_with({c}, 'http://') "
            f"THEN replace({c}, 'http://', 'https://') ELSE 'https://' || {c} END")


def first_tag_text_sql(c: str, tag: str, css_class: str | None = None, must_contain: str | None = None) -> str:
    from codelens.functions.html import TAG_RE, open_tag_re

    pat = rf"(?is){open_tag_re(tag, css_class)}(.*?)</{tag}\s*>"
    items = (f"list_transform(regexp_extract_all({c}, {sql_str(pat)}, 1), "
             f"lambda x: {strip_sql(decode_entities_sql(f'regexp_replace(x, {sql_str(TAG_RE)}, {chr(39)}{chr(39)}, {chr(39)}g{chr(39)})'))})")
    if must_contain:
        items = f"list_filter({items}, lambda x: contains(x, {sql_str(must_contain)}))"
    return f"coalesce({items}[1], '')"
