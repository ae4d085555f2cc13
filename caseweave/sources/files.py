"""Files, page extracts and search results as DataFrames."""

from __future__ import annotations

import html
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as D

#: Largest upload, extensions by use, and what makes a page native text or an extract doubtful.
MAX_UPLOAD = 50 << 20
UPLOADS, CORPUS_FILES, MODEL_FILES = ("pdf", "png", "jpg", "jpeg", "tif", "tiff"), ("pdf", "txt", "md"), ("pdf", "docx", "txt", "md")
NATIVE_CHARS, DOUBTFUL_CHARS, MIN_CONFIDENCE = 20, 3, 0.75


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), r"\.([^./]+)$", 1))


def uploads(spark: SparkSession, path: str, allowed: tuple[str, ...] = UPLOADS) -> DataFrame:
    """Files under ``path`` (path, length, content) of an allowed kind and size. The content is read only if selected."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where((F.col("length") <= MAX_UPLOAD) & extension(F.col("path")).isin(*allowed))


def corpus_texts(spark: SparkSession, path: str) -> DataFrame:
    """Text and markdown files as (path, title, text): UTF-8, undecodable bytes left out; the title is the file's name."""
    files = uploads(spark, path, CORPUS_FILES).where(extension(F.col("path")).isin("txt", "md"))

    @F.pandas_udf(D.StringType())
    def decode(contents: pd.Series) -> pd.Series:
        return contents.map(lambda b: (b or b"").decode("utf-8", "ignore"))

    return files.select("path", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("title"), decode("content").alias("text"))


def native_pdf(text: Column, pages: Column) -> Column:
    """Whether extracted text has NATIVE_CHARS characters a page that aren't blank."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), "[ \n]", "")) / F.greatest(pages, F.lit(1)) >= NATIVE_CHARS


def route(path: Column, text: Column, pages: Column) -> Column:
    """``native``, ``ocr`` or ``error``, by extension and what the file's own text holds."""
    kind = extension(path)
    return F.when((kind == "pdf") & native_pdf(text, pages), F.lit("native")).when(kind.isin(*UPLOADS), F.lit("ocr")).otherwise(F.lit("error"))


def doubtful_page(text: Column) -> Column:
    """OCR text with fewer than DOUBTFUL_CHARS characters besides code fences."""
    return F.length(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "```[a-z]*", ""))) < DOUBTFUL_CHARS


def low_confidence(uncertain: Column, confidence: Column) -> Column:
    return (F.size(F.coalesce(uncertain, F.array().cast("array<string>"))) > 0) | (F.coalesce(confidence, F.lit(1.0)) < MIN_CONFIDENCE)


def recognise(pages: DataFrame, ocr: Callable[[bytes], tuple[str, float, list[str]]]) -> DataFrame:
    """pages (doc_id, page, image) to text, confidence and uncertain passages, by a caller's recogniser."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [ocr(x) for x in frame["image"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "page": frame["page"], "text": [f[0] for f in found], "confidence": [f[1] for f in found], "uncertain": [f[2] for f in found]})

    return pages.mapInPandas(run, "doc_id long, page int, text string, confidence double, uncertain array<string>")


def join_pages(pages: DataFrame) -> DataFrame:
    """Pages of a document in order, with a blank line between; flags or-ed, uncertain passages in order."""
    rows = F.array_sort(F.collect_list(F.struct("page", F.col("text").alias("t"), F.coalesce("uncertain", F.array().cast("array<string>")).alias("u"))))
    doubt = F.bool_or(doubtful_page(F.col("text")) | low_confidence(F.col("uncertain"), F.col("confidence")))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda r: r["t"]), "\n\n").alias("text"), F.flatten(F.transform(rows, lambda r: r["u"])).alias("uncertain"), doubt.alias("low_confidence"), F.min("confidence").alias("confidence"))


def plain_text(markup: Column) -> Column:
    """Markup without comments, scripts, styles and tags, in single spaces; entities stay."""
    bare = F.regexp_replace(F.coalesce(markup, F.lit("")), r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>|<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


@F.pandas_udf(D.StringType())
def unescape(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: html.unescape(t or ""))


def links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href, label) of all links of pages (page_id, html)."""
    pattern = r'(?is)<a\b[^>]*?\bhref="([^"]*)"[^>]*>(.*?)</a>'
    both = F.arrays_zip(F.regexp_extract_all("html", F.lit(pattern), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(pattern), F.lit(2)).alias("label"))
    return pages.select("page_id", F.posexplode(both).alias("pos", "l")).select("page_id", "pos", "l.href", plain_text(F.col("l.label")).alias("label"))


def unwrapped(href: Column) -> Column:
    """The target of a redirect link (its uddg parameter), or the link itself."""
    inner = F.regexp_extract(href, r"[?&]uddg=([^&]+)", 1)
    return F.when(inner != "", F.try_url_decode(inner)).otherwise(href)


def search_results(answers: DataFrame, limit: int = 4) -> DataFrame:
    """answers (query_id, html) to the first results (query_id, pos, title, snippet, url)."""
    head = r'(?is)<a\b[^>]*class="[^"]*result__a[^"]*"[^>]*href="([^"]*)"[^>]*>(.*?)</a>'
    body = r'(?is)<a\b[^>]*class="[^"]*result__snippet[^"]*"[^>]*>(.*?)</a>'
    rows = F.arrays_zip(
        F.regexp_extract_all("html", F.lit(head), F.lit(1)).alias("url"), F.regexp_extract_all("html", F.lit(head), F.lit(2)).alias("title"), F.regexp_extract_all("html", F.lit(body), F.lit(1)).alias("snippet")
    )
    out = answers.select("query_id", F.posexplode(F.slice(rows, 1, limit)).alias("pos", "r"))
    text = lambda c: unescape(plain_text(F.col(c)))
    return out.select("query_id", "pos", text("r.title").alias("title"), text("r.snippet").alias("snippet"), unwrapped(F.replace("r.url", F.lit("&amp;"), F.lit("&"))).alias("url"))


def leads(queries: DataFrame, results: DataFrame) -> DataFrame:
    """queries (query_id, topic) with their results that have an address, or one row marked insufficient."""
    found = results.where(F.coalesce("url", F.lit("")) != "")
    rows = queries.join(found, "query_id", "left")
    return rows.select("query_id", "topic", "title", "snippet", "url", F.when(F.col("url").isNull(), F.lit("insufficiente")).otherwise(F.lit("da_verificare")).alias("state"))


def safe_names(docs: DataFrame) -> DataFrame:
    """docs (section, file_name, doc_id) with ``entry``: section/name, later ones of a name numbered."""
    from pyspark.sql import Window

    base = F.regexp_extract("file_name", r"([^/]*)$", 1)
    rows = docs.withColumn("_base", base).withColumn("_n", F.row_number().over(Window.partitionBy("section", "_base").orderBy("doc_id")))
    stem, tail = F.regexp_extract("_base", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("_base", r"^(.*?)(\.[^.]*)?$", 2)
    name = F.when(F.col("_n") == 1, F.col("_base")).otherwise(F.concat(stem, F.lit("_"), F.col("_n").cast("string"), tail))
    return rows.withColumn("entry", F.concat_ws("/", "section", name)).drop("_base", "_n")
