"""Reading captured pages: tables of captures, or folders of saved HTML files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NOT_HTML = "not HTML content"
HTML_TYPES = "text/html|application/xhtml"
SNIFF = r"(?is)<html[\s>]|<!doctype\s+html"


def numbered(files: DataFrame) -> DataFrame:
    """Add ``page_id`` from a row's file, by name, and its place in it: the same however files are split for reading.

    The table of file names, a row for each file of the listing that the driver holds anyway, is what is broadcast.
    """
    rows = files.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    names = files.select(F.col("_metadata.file_path").alias("_file")).distinct()
    held = names.withColumn("_number", F.row_number().over(Window.orderBy("_file")).cast("long") - 1)
    placed = rows.join(F.broadcast(held), "_file", "left")
    return placed.withColumn("page_id", F.shiftleft("_number", 33) + F.col("_row")).drop("_file", "_row", "_number")


def declared_charset(pages: DataFrame) -> Column | None:
    """The charset a capture names: its ``charset`` column, else that of its ``content_type``."""
    found = [F.nullif(F.trim("charset"), F.lit(""))] if "charset" in pages.columns else []
    if "content_type" in pages.columns:
        found.append(F.nullif(F.regexp_extract("content_type", r"""(?i)charset\s*=\s*["']?([A-Za-z0-9_\-]+)""", 1), F.lit("")))
    return F.coalesce(*found) if found else None


def decoded_pages(pages: DataFrame) -> DataFrame:
    """Captures whose body is bytes (``content``, or a binary ``html``) with the text in ``html`` instead."""
    kinds = dict(pages.dtypes)
    body = "html" if kinds.get("html") == "binary" else "content" if "html" not in kinds and kinds.get("content") == "binary" else None
    if body is None:
        return pages
    text = decode_charset(F.col(body), declared_charset(pages))
    return pages.withColumn("html", text) if body == "html" else pages.withColumn("html", text).drop(body)


def read_pages(spark: SparkSession, path: str, format: str = "parquet", **options) -> DataFrame:
    """A capture table (parquet, json, csv, orc) with at least url and html, or ``content`` bytes in place of html.

    Bytes are decoded by ``decode_charset`` under the charset that a ``charset`` column or the ``content_type`` declares.
    Without a ``page_id`` rows of Parquet files are numbered by file name and place in the file; those of other formats by
    the order of the splits they are read in, so they keep their numbers only while files are split alike.
    """
    pages = spark.read.options(**options).format(format).load(path)
    if "page_id" not in pages.columns:
        pages = numbered(pages) if format == "parquet" else pages.withColumn("page_id", F.monotonically_increasing_id())
    return decoded_pages(pages)


def read_html_folder(spark: SparkSession, path: str, base_url: str) -> DataFrame:
    """A folder of saved .html files; the URL is the file path below the folder, on ``base_url``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").option("recursiveFileLookup", "true").load(path)
    root = F.lit(path.rstrip("/") + "/")
    below = F.regexp_replace(F.col("path"), "^file:/*", "/")
    url = F.concat(F.lit(base_url.rstrip("/") + "/"), F.replace(below, root, F.lit("")))
    return files.select(
        F.monotonically_increasing_id().alias("page_id"), url.alias("url"), decode_charset(F.col("content")).alias("html"),
        F.col("modificationTime").alias("fetched_at"))


# Charsets that web pages name and that take a table to decode.
TABLE_CHARSETS = [
    "GBK", "GB2312", "GB18030", "BIG5", "BIG5-HKSCS", "SHIFT_JIS", "SHIFT-JIS", "EUC-JP", "ISO-2022-JP", "EUC-KR", "KOI8-R", "KOI8-U",
    *(f"WINDOWS-{n}" for n in (1250, 1251, *range(1253, 1259))), *(f"ISO-8859-{n}" for n in (*range(2, 12), 13, 14, 15, 16)), "WINDOWS-874", "TIS-620",
    "UTF-16", "UTF-16LE", "UTF-16BE", "UTF-16LE-MARK", "UTF-16BE-MARK"]
WIDER = {"GB2312": "gb18030", "GBK": "gb18030", "SHIFT_JIS": "cp932", "SHIFT-JIS": "cp932", "EUC-KR": "cp949", "WINDOWS-874": "cp874", "UTF-16": "utf-16-le",
         "UTF-16LE-MARK": "utf-16", "UTF-16BE-MARK": "utf-16"}


def _decode_by_table(spark_columns: tuple[Column, Column]) -> Column:
    wider = dict(WIDER)

    @F.pandas_udf("string")
    def run(content: pd.Series, charset: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else bytes(c).decode(wider.get(n, n), "replace") for c, n in zip(content, charset, strict=True)], dtype=object)

    return run(*spark_columns)


def decode_charset(content: Column, declared: Column | None = None) -> Column:
    """Bytes to text by the declared charset, of UTF-16 in the byte order its mark tells. A byte order mark decides where
    none is declared; else absent or iso-8859-1 (the transport default)
    means look at the bytes: valid UTF-8, else the charset a meta tag names anywhere, else windows-1252, which is also
    taken for charsets nobody knows. Only content in one of ``TABLE_CHARSETS`` is sent to Python, in Arrow batches."""
    latin = F.decode(content, "ISO-8859-1")
    named = F.upper(F.regexp_extract(latin, r"(?i)<meta[^>]*charset=[\"']?([A-Za-z0-9_\-]+)", 1))
    stated = F.lit("") if declared is None else F.coalesce(F.upper(F.trim(declared)), F.lit(""))
    mark = F.hex(F.substring(content, 1, 3))
    tells = ~stated.isin("", "ISO-8859-1", "LATIN-1", "LATIN1")
    charset = (
        F.when((mark == "EFBBBF") & (~tells | stated.isin("UTF-8", "UTF8")), "UTF-8-MARK")
        .when(tells & ~stated.startswith("UTF-16"), stated)
        .when(mark.startswith("FFFE"), "UTF-16LE-MARK").when(mark.startswith("FEFF"), "UTF-16BE-MARK")
        .when(tells, stated)
        .when(F.is_valid_utf8(content.cast("string")), "UTF-8").otherwise(named))
    # The single-byte characters in which windows-1252 differs from ISO-8859-1.
    codes = "".join(chr(i) for i in range(128, 160))
    cp1252 = "".join(bytes([i]).decode("cp1252", "replace") for i in range(128, 160))
    by_table = _decode_by_table((F.when(charset.isin(TABLE_CHARSETS), content), charset))
    return (
        F.when(charset == "UTF-8-MARK", F.make_valid_utf8(F.substring(content, 4, 2147483647).cast("string")))
        .when(charset.isin("UTF-8", "UTF8"), F.make_valid_utf8(content.cast("string")))
        .when(charset.isin(TABLE_CHARSETS), by_table)
        .otherwise(F.translate(latin, codes, cp1252)))


def outcomes(pages: DataFrame) -> DataFrame:
    """Add ``status`` ('ok' / 'error') and ``error``; a bad row never stops a job."""
    if "content_type" in pages.columns:
        html_like = F.coalesce(F.col("content_type").rlike(HTML_TYPES), F.lit(False))
    else:
        html_like = F.coalesce(F.col("html").rlike(SNIFF), F.lit(False))
    fetched = F.col("error") if "error" in pages.columns else F.lit(None).cast("string")
    error = F.coalesce(fetched, F.when(F.col("html").isNull(), "no content"), F.when(~html_like, NOT_HTML))
    return pages.withColumns({"error": error, "status": F.when(error.isNull(), "ok").otherwise("error")})


def html_only(pages: DataFrame) -> DataFrame:
    return outcomes(pages).filter(F.col("status") == "ok").drop("status", "error")


def outcome_counts(pages: DataFrame) -> DataFrame:
    return outcomes(pages).groupBy("status", F.coalesce("error", F.lit("")).alias("error")).agg(F.count("*").alias("n"))
