"""Readers and writers for the file formats the original jobs exchange.

Spreadsheets are replaced by CSV/parquet exports (Spark has no xlsx reader);
pickled dicts by JSON lines. Every reader is a lazy DataFrame with an explicit
or all-string schema: schema inference is what turned codes into integers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelens.functions.html import force_https
from codelens.functions.text import company_from_filename

# CSV dialect: RFC 4180 quoting, cells may span lines, whitespace kept.
CSV_OPTIONS = {
    "header": "true",
    "multiLine": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}
# Without cells that span lines a file can be split among tasks.
LINE_OPTIONS = {**CSV_OPTIONS, "multiLine": "false"}

# Dictionary export column order (code, title, group list,
# definition, cross references, examples) and the columns kept.
DICTIONARY_COLUMNS = ["code", "title", "groups", "definition", "cross_references", "examples"]
DICTIONARY_KEEP = [0, 1, 3, 5]
CODE_PATTERN = r"^([A-Z]|[0-9]{2,5})$"


def read_csv_strings(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """CSV with a header, every column a string (no inference)."""
    r = spark.read.options(**CSV_OPTIONS)
    if columns:
        r = r.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    return r.csv(path)


def read_csv_typed(spark: SparkSession, path: str, schema: T.StructType | str, multi_line: bool = False) -> DataFrame:
    """CSV with an explicit schema (e.g. codes forced to string); ``multi_line``
    for cells that span lines, at the price of one task per file."""
    return spark.read.options(**(CSV_OPTIONS if multi_line else LINE_OPTIONS)).schema(schema).csv(path)


def read_dictionary(spark: SparkSession, path: str, keep: list[int] | None = DICTIONARY_KEEP) -> DataFrame:
    """Dictionary export with preamble lines: rows are read without a header,
    the preamble and header lines are dropped by a predicate on the code column
    (no row numbers needed), and columns are picked by position."""
    opts = dict(CSV_OPTIONS, header="false")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in DICTIONARY_COLUMNS])
    df = spark.read.options(**opts).schema(schema).csv(path)
    df = df.where(F.col("code").rlike(CODE_PATTERN))
    if keep is not None:
        df = df.select(*[DICTIONARY_COLUMNS[i] for i in keep])
    return df


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Alphabetical index: (code, description, extra); the third column is
    dropped, rows with any null dropped, description renamed to definition."""
    opts = dict(LINE_OPTIONS, header="false")
    schema = "code string, description string, extra string"
    df = spark.read.options(**opts).schema(schema).csv(path).where(F.col("code").rlike(CODE_PATTERN))
    return df.drop("extra").na.drop("any").withColumnRenamed("description", "definition")


def read_url_map(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of {report name: [urls]} -> (pdf_name, url): stacked, nulls
    dropped, https forced, distinct."""
    m = spark.read.text(path).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    e = m.select(F.explode("m").alias("pdf_name", "urls")).select("pdf_name", F.explode("urls").alias("url"))
    e = e.where(F.col("url").isNotNull())
    return e.select("pdf_name", force_https("url").alias("url")).dropDuplicates()


def list_report_files(spark: SparkSession, folder: str, glob: str = "*.pdf") -> DataFrame:
    """(path, file_name, company) for the report files in a folder. Only the
    path column is selected, so file contents are never read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    f = files.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"))
    return f.withColumn("company", company_from_filename("file_name"))


class CachedReference:
    """A reference table read once and kept in executor memory; ``refresh``
    drops and re-reads it (the original expired it after 600 s)."""

    def __init__(self, spark: SparkSession, path: str, fmt: str = "csv", schema: T.StructType | str | None = None):
        self.spark, self.path, self.fmt, self.schema = spark, path, fmt, schema
        self._df: DataFrame | None = None

    def get(self) -> DataFrame:
        if self._df is None:
            r = self.spark.read
            if self.fmt == "csv":
                r = r.options(**CSV_OPTIONS)
            if self.schema is not None:
                r = r.schema(self.schema)
            self._df = r.format(self.fmt).load(self.path).cache()
        return self._df

    def refresh(self) -> DataFrame:
        if self._df is not None:
            self._df.unpersist()
            self._df = None
        return self.get()


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.options(**CSV_OPTIONS)
    w.save(path)


def write_result_bundle(tables: dict[str, DataFrame], base: str, fmt: str = "parquet") -> dict[str, str]:
    """One directory per named result table under ``base``."""
    out = {}
    for name, df in tables.items():
        p = f"{base.rstrip('/')}/{name}"
        write_table(df, p, fmt)
        out[name] = p
    return out


# Column names of the declared-codes list and of the link lists.
DECLARED_COLUMNS = {"UEN": "uen", "entity_name": "company", "ssic_code": "ssic_code", "ssic_code2": "ssic_code2"}
LIST_ITEM_RE = r"'([^']*)'"


def read_declared_codes(spark: SparkSession, path: str) -> DataFrame:
    """Declared-codes CSV (UEN, entity_name, ssic_code, ssic_code2, ...) ->
    the ``truth`` shape (uen, company, ssic_code, ssic_code2); codes stay
    strings and are padded to 5 characters only when shorter."""
    from codelens.functions.codes import pad_code

    df = read_csv_strings(spark, path)
    out = df.select(*[F.col(f"`{src}`").alias(dst) for src, dst in DECLARED_COLUMNS.items()])
    return out.withColumn("ssic_code", pad_code("ssic_code")).withColumn(
        "ssic_code2", F.when(F.col("ssic_code2").isNotNull(), pad_code("ssic_code2")))


def parse_list_text(c) -> "F.Column":
    """A Python-style list saved as text ("['a', 'b']") -> array<string>."""
    col = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract_all(col, F.lit(LIST_ITEM_RE), 1)


def read_link_lists(spark: SparkSession, path: str, site_col: str = "Org Website",
                    links_col: str = "Filtered Links", name_col: str | None = "Company") -> DataFrame:
    """Link-list CSV -> (company, site, links array)."""
    df = read_csv_strings(spark, path)
    cols = [F.col(f"`{name_col}`").alias("company")] if name_col else []
    return df.select(*cols, F.col(f"`{site_col}`").alias("site"), parse_list_text(F.col(f"`{links_col}`")).alias("links"))
