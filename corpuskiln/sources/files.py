"""Files as sources of documents: a recursive scan, loaders by file type, JSON lines, and article sinks."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskiln import config
from corpuskiln.functions import text
from corpuskiln.operators.sampling import hash_sample

EVAL_SCHEMA = "query string, source_doc_id string, source_title string"
ADVERSARIAL_SCHEMA = "query string"
METADATA = "struct<source_file:string,file_type:string,processed_at:timestamp,trust_score:double,version:int,custom:map<string,string>>"


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of all regular files below a folder but those whose name starts with a dot.

    Raises FileNotFoundError for a folder that does not exist. Local folders are listed by the driver, so that files
    in hidden folders and names starting with an underscore come too, and read in tasks; other file systems are
    listed by Spark.
    """
    if "://" in folder and not folder.startswith("file://"):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
        return files.filter(~F.element_at(F.split("path", "/"), -1).startswith(".")).select("path", "content")
    root = folder.removeprefix("file://")
    if not os.path.isdir(root):
        raise FileNotFoundError(root)
    paths = sorted(os.path.join(d, f) for d, _, fs in os.walk(root) for f in fs if not f.startswith("."))

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:  # one file at a time in memory
                with open(path, "rb") as f:
                    yield pd.DataFrame({"path": [path], "content": [f.read()]})

    listed = spark.createDataFrame([(p,) for p in paths], "path string")
    slices = max(1, min(len(paths), spark.sparkContext.defaultParallelism * 4))
    return listed.repartition(slices).mapInPandas(load, "path string, content binary")


def _pdf_reader() -> Callable[[bytes], tuple[str, int]] | None:
    """Reads a PDF's text and number of pages if a library for it is installed."""
    try:
        import pymupdf
    except ImportError:
        return None

    def read(raw: bytes) -> tuple[str, int]:
        with pymupdf.open(stream=raw, filetype="pdf") as pdf:
            return "\n\n".join(page.get_text() for page in pdf).strip(), pdf.page_count

    return read


def pdf_text(files: DataFrame, reader: Callable[[], Callable[[bytes], tuple[str, int]] | None] = _pdf_reader) -> DataFrame:
    """(path, content, text, pages, reason) of PDF files; the reason says why there is no text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = reader()
        for batch in batches:
            for path, raw in zip(batch["path"], batch["content"]):
                found, pages, reason = None, None, None
                if read is None:
                    reason = "no PDF reader installed"
                else:
                    try:
                        found, pages = read(bytes(raw))
                    except Exception as e:  # a broken file fails by itself, not its task
                        reason = f"unreadable: {type(e).__name__}"
                yield pd.DataFrame({"path": [path], "content": [raw], "text": [found], "pages": [pages], "reason": [reason]}).astype({"pages": "Int64"})

    return files.mapInPandas(run, "path string, content binary, text string, pages bigint, reason string")


def documents(files: DataFrame, processed_at: Column, reader=_pdf_reader) -> DataFrame:
    """(doc_id, content, metadata, status, reason) of files (path, content): loaded or failed, with the reason.

    Text files are read as UTF-8, bytes that are none replaced; of pages and Markdown the text remains. Files of
    other types fail, so do files without text; they have a null content.
    """
    kind = text.file_type(F.col("path"))
    plain = F.make_valid_utf8(F.col("content").cast("string"))
    other = files.filter(F.coalesce(kind != "pdf", F.lit(True))).select(
        "path", "content",
        F.when(kind == "html", text.html_text(plain)).when(kind == "md", text.markdown_text(plain)).when(kind == "txt", plain).alias("text"),
        F.lit(None).cast("bigint").alias("pages"),
        F.when(kind.isNull(), F.concat(F.lit("unsupported type: ."), text.extension(F.col("path")))).alias("reason"),
    )
    loaded = other.unionByName(pdf_text(files.filter(kind == "pdf"), reader))
    title = F.when(kind == "html", text.html_title(F.make_valid_utf8(F.col("content").cast("string"))))
    custom = F.when(F.col("pages").isNotNull(), F.create_map(F.lit("page_count"), F.col("pages").cast("string"))).when(title.isNotNull(), F.create_map(F.lit("title"), title)).otherwise(F.create_map().cast("map<string,string>"))
    reason = F.coalesce("reason", F.when(~text.not_blank(F.col("text")), F.lit("empty")))
    return loaded.select(
        text.doc_id(F.col("path"), F.col("content")).alias("doc_id"),
        F.when(reason.isNull(), F.col("text")).alias("content"),
        F.struct(F.col("path").alias("source_file"), kind.alias("file_type"), processed_at.alias("processed_at"), F.lit(1.0).alias("trust_score"), F.lit(1).alias("version"), custom.alias("custom")).alias("metadata"),
        F.when(reason.isNull(), "loaded").otherwise("failed").alias("status"),
        reason.alias("reason"),
    )


def json_lines(spark: SparkSession, path: str, schema: str = EVAL_SCHEMA, limit: int | None = None) -> DataFrame:
    """Rows of a JSON-lines file; blank lines are skipped, the first ``limit`` are kept if given."""
    rows = spark.read.schema(schema).json(path).dropna("all")
    if limit is None:
        return rows
    place = (F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return rows.orderBy(*place).limit(limit)


def write_json_lines(df: DataFrame, path: str, force: bool = False, least: int = config.EVAL_MIN_ROWS) -> bool:
    """Writes ``df`` unless the path already holds ``least`` rows and ``force`` is not set; whether it wrote."""
    spark = df.sparkSession
    if not force:
        try:
            if spark.read.schema(df.schema).json(path).limit(least).count() >= least:
                return False
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    df.write.mode("overwrite").json(path)
    return True


def matching_articles(articles: DataFrame, id_col: str, title_col: str, text_col: str, target: int | None = config.SEED_TARGET, max_scan: int | None = config.SEED_MAX_SCAN, keywords: tuple[str, ...] = config.TITLE_KEYWORDS) -> DataFrame:
    """(id, article): the first ``target`` articles, of the first ``max_scan`` by id, whose title has a keyword and
    whose text is not blank (all, for None), as 'Title: ...', an empty line and the text."""
    if max_scan is not None:
        last = articles.select(id_col).orderBy(id_col).limit(max_scan).agg(F.max(id_col)).first()[0]  # ids alone are sorted
        articles = articles.filter(F.col(id_col) <= F.lit(last))
    wanted = articles.filter(text.title_matches(F.col(title_col), keywords) & text.not_blank(F.col(text_col)))
    if target is not None:
        wanted = wanted.orderBy(id_col).limit(target)
    return wanted.select(F.col(id_col).alias("id"), F.concat(F.lit("Title: "), title_col, F.lit("\n\n"), text_col).alias("article"))


def write_articles(articles: DataFrame, folder: str, prefix: str = "wiki_") -> DataFrame:
    """Writes each article to a file of its own below ``folder`` (one that all executors share); the paths written."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            paths = []
            for key, body in zip(batch["id"], batch["article"]):
                path = os.path.join(folder, f"{prefix}{key}.txt")
                with open(path + ".part", "w", encoding="utf-8") as f:
                    f.write(body)
                os.replace(path + ".part", path)  # a task that runs again leaves whole files
                paths.append(path)
            yield pd.DataFrame({"path": paths})

    return articles.mapInPandas(run, "path string")


def evaluation_sample(docs: DataFrame, rows: int = config.EVAL_SAMPLE, pattern: str = "wiki_") -> DataFrame:
    """A repeatable sample of documents from matching files, by a hash of their id (not the draw of a random generator)."""
    return hash_sample(docs.filter(F.col("metadata.source_file").rlike(pattern)), F.col("doc_id"), rows, config.SAMPLE_SEED)


def report(metrics: DataFrame, title: str, most: int = 1000) -> str:
    """A Markdown table of a small table of figures; raises ValueError beyond ``most`` rows."""
    rows = metrics.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")
    head = "| " + " | ".join(metrics.columns) + " |\n|" + "---|" * len(metrics.columns)
    show = lambda v: f"{v:.4f}" if isinstance(v, float) else str(v)
    return f"# {title}\n\n{head}\n" + "".join("| " + " | ".join(map(show, r)) + " |\n" for r in rows)


