"""Readers of the stored tables and files."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as D

from tidemark.functions import meta as M
from tidemark.functions import text as T
from tidemark.session import PARTITIONS_KEY

CATALOG_SCHEMA = (
    "id string, title string, category string, region string, market string, platform string, "
    "language string, url string, crawl_mode string, priority string, notes string"
)
METADATA_SCHEMA = (
    "source_id string, doc_id string, title string, platform string, platform_display string, region string, "
    "region_pack string, document_type string, source_category string, language string, source_url string, "
    "priority string, notes string, raw_file string, processed_at string, parser_version string, "
    "source_title string, source_type string, country_code string, distribution_mode string, brand_id string, "
    "block_id string, is_global_fallback boolean"
)
METADATA_COLUMNS = [f.split()[0] for f in METADATA_SCHEMA.split(", ")]
MANIFEST_SCHEMA = (
    "source_id string, markdown_path string, metadata_path string, title string, platform string, "
    "region string, document_type string, raw_suffix string"
)


#: Bytes of listed files that a task reads, at most as long as no file is larger, and what it hands on at once.
TASK_BYTES, BATCH_BYTES = 1 << 25, 1 << 22
#: What opening a file costs, in bytes read.
OPEN_BYTES = 4096


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table of a data folder."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table over ``spark.tidemark.partitions`` tasks, where that is set; else as its files are split.

    Local sessions set it to their cores, as their tables are of one small file; on a cluster the split size does it.
    """
    wanted = df.sparkSession.conf.get(PARTITIONS_KEY, None)
    return df.repartition(int(wanted)) if wanted else df


def jdbc_table(spark: SparkSession, url: str, name: str, key: str, lower: int, upper: int, parts: int, **options: str) -> DataFrame:
    """A database table read in parallel key ranges (the driver jar comes with the cluster)."""
    return spark.read.jdbc(url, name, column=key, lowerBound=lower, upperBound=upper, numPartitions=parts, properties=options)


def listed_files(folder: str, names: DataFrame, suffixes: list[str]) -> DataFrame:
    """The files of a folder that a table (name, size) lists: path, content, length, modificationTime.

    Tasks open the files of their own rows; the driver sees no file. As in Spark's readers, an empty file gives no row.
    """
    wanted = F.lit(False)
    for suffix in suffixes:
        wanted = wanted | F.endswith(F.col("name"), F.lit(suffix))
    listed = names.filter(wanted & (F.col("size") > 0))
    cost = listed.agg(F.coalesce(F.sum(F.col("size") + OPEN_BYTES), F.lit(0))).first()[0]
    tasks = max(names.sparkSession.sparkContext.defaultParallelism, math.ceil(cost / TASK_BYTES))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)
        for batch in batches:
            rows, held = [], 0
            for name in batch.column(0).to_pylist():
                with store.open_input_file(f"{path}/{name}") as file:
                    content = file.read()
                rows.append((f"{folder}/{name}", content, len(content), store.get_file_info(f"{path}/{name}").mtime))
                held += len(content) + OPEN_BYTES
                if held >= BATCH_BYTES:
                    yield _file_rows(rows)
                    rows, held = [], 0
            yield _file_rows(rows)

    dealt = listed.select("name").repartition(tasks, "name").distinct()
    return dealt.mapInArrow(read, "path string, content binary, length long, modificationTime timestamp")


def _file_rows(rows: list[tuple]) -> pa.RecordBatch:
    types = {"path": pa.string(), "content": pa.binary(), "length": pa.int64(), "modificationTime": pa.timestamp("us", "UTC")}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types.values())], list(types))


def whole_files(
    spark: SparkSession, folder: str, suffixes: list[str], recursive: bool = False, names: DataFrame | None = None
) -> DataFrame:
    """Text files as rows: path, text, size, mtime; with ``names`` those that the table lists."""
    if names is not None:
        text = F.col("content").cast("string").alias("text")
        return listed_files(folder, names, suffixes).select("path", text, F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    glob = "*{" + ",".join(suffixes) + "}"
    files = spark.read.option("recursiveFileLookup", str(recursive).lower()).text(folder, wholetext=True, pathGlobFilter=glob)
    return files.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("value").alias("text"),
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_modification_time").alias("mtime"),
    )


def markdown_sources(spark: SparkSession, processed: str, brand: str | None = None, names: DataFrame | None = None) -> DataFrame:
    """Processed markdown files of one folder (those that ``names`` lists), and brand files at any depth."""
    files = whole_files(spark, processed, [".md"], names=names)
    return files if brand is None else files.unionByName(whole_files(spark, brand, [".md"], recursive=True))


def knowledge_files(spark: SparkSession, folder: str) -> DataFrame:
    """All md, txt and markdown files below a folder."""
    return whole_files(spark, folder, [".md", ".txt", ".markdown"], recursive=True)


def raw_files(spark: SparkSession, folder: str, names: DataFrame | None = None) -> DataFrame:
    """Raw html and pdf files as bytes: path, source_id, suffix, content, size, mtime; with ``names`` those it lists."""
    if names is None:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{html,pdf}").load(folder)
    else:
        files = listed_files(folder, names, [".html", ".pdf"])
    return files.select(
        "path",
        M.file_stem(F.col("path")).alias("source_id"),
        M.file_suffix(F.col("path")).alias("suffix"),
        "content",
        F.col("length").alias("size"),
        F.col("modificationTime").alias("mtime"),
    )


def raw_pages(files: DataFrame, *more: str) -> DataFrame:
    """The html files among raw files as a page table (page_id, html), with ``more`` of their columns.

    A join would bring these to their page as well, but read each file twice; and as Spark takes the table of names for the
    files' size, it may broadcast their contents through the driver.
    """
    return files.filter("suffix = '.html'").select(
        F.col("path").alias("page_id"), "source_id", M.lenient_utf8(F.col("content")).alias("html"), *more
    )


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """The source catalog, a JSON list; ``position`` keeps the order of the file."""
    rows = spark.read.schema(CATALOG_SCHEMA).json(path, multiLine=True)
    return rows.withColumn("position", F.monotonically_increasing_id())


def metadata_files(spark: SparkSession, folder: str, names: DataFrame | None = None) -> DataFrame:
    """Metadata of the processed documents (those that ``names`` lists), manifest left out; ids default to the file name."""
    if names is None:
        rows = spark.read.schema(METADATA_SCHEMA).json(folder, multiLine=True, pathGlobFilter="*.json")
        path = F.col("_metadata.file_path")
        rows = rows.withColumns({"path": path, "file_time": F.col("_metadata.file_modification_time")})
    else:
        files = whole_files(spark, folder, [".json"], names=names).filter(~T.is_blank("text"))
        # a file holds an object or a list of them; one that is neither is a row without fields
        parsed = F.from_json("text", D.ArrayType(D.StructType.fromDDL(METADATA_SCHEMA)))
        files = files.select("path", F.col("mtime").alias("file_time"), parsed.alias("rows")).filter("rows is null or size(rows) > 0")
        rows = files.select("path", "file_time", F.explode_outer("rows").alias("row")).select("row.*", "path", "file_time")
    kept = rows.filter(~F.col("path").endswith("/manifest.json"))
    name = F.coalesce(F.nullif("source_id", F.lit("")), F.nullif("doc_id", F.lit("")), M.file_stem(F.col("path")))
    return kept.withColumn("source_id", name)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST_SCHEMA).json(path, multiLine=True)


def event_texts(lines: DataFrame) -> DataFrame:
    """Event-stream text (value) decoded into run_id, event and the payload fields."""
    from tidemark.functions import workflow as W

    schema = "run_id string, step string, status string, message string, duration_ms int, error_type string, ts timestamp"
    decoded = lines.withColumn("d", W.decode_event("value")).filter(F.col("d.data").isNotNull())
    parsed = decoded.withColumn("p", F.from_json("d.data", schema))
    return parsed.select(F.col("d.event").alias("event"), "p.*")


def token_documents(documents: DataFrame, text: str = "text") -> DataFrame:
    """Adds the distinct tokens of a text column."""
    return documents.withColumn("tokens", T.token_set(text))
