"""File inventories and content-addressed blobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.scratch import exists, written
from cairn.sources.text_units import format_kind


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Every file below a folder with its kind, size and content hash; nothing is written."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), format_kind(name).alias("kind"), "length", F.sha2("content", 256).alias("content_hash"), (F.col("length") == 0).alias("empty"))


def blob_path(digest):
    """Where a blob lies: its first two digits, then all of them."""
    return F.concat(F.left(digest, F.lit(2)), F.lit("/"), digest)


def put_blobs(contents: DataFrame, root: str, batch: str, content: str = "content") -> DataFrame:
    """Store bytes under their hash, those not there yet once each: ``digest`` and whether it is ``new``.

    Blobs are rows of Parquet by the first two digits of their hash; a batch that runs
    again writes the same part.
    """
    spark = contents.sparkSession
    one = contents.select(F.sha2(content, 256).alias("digest"), F.col(content).cast("binary").alias("content")).where("content IS NOT NULL").dropDuplicates(["digest"])
    shard = F.left("digest", F.lit(2))
    one = written(one.withColumn("shard", shard), "blobs")
    there = blobs(spark, root).where(F.col("batch") != batch).select("digest").withColumn("new", F.lit(False))
    told = one.join(there, "digest", "left").withColumn("new", F.coalesce("new", F.lit(True)))
    fresh = told.where("new").select("digest", "content", "shard")
    fresh.repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(f"{root}/batch={batch}")
    return told.select("digest", "new")


def blobs(spark: SparkSession, root: str) -> DataFrame:
    """``digest, content, batch, shard`` of all stored blobs; a filter on the shard prunes folders."""
    schema = "digest string, content binary, batch string, shard string"
    return spark.read.schema(schema).parquet(root) if exists(spark, root) else spark.createDataFrame([], schema)


def get_blobs(spark: SparkSession, root: str, digests: DataFrame) -> DataFrame:
    """``digest, content, state``: ``ok``, ``missing``, or ``corrupt`` where the bytes no longer have their hash."""
    asked = digests.select("digest").distinct().withColumn("shard", F.left("digest", F.lit(2)))
    found = asked.join(blobs(spark, root).select("digest", "shard", "content"), ["digest", "shard"], "left")
    state = F.when(F.col("content").isNull(), "missing").when(F.sha2("content", 256) != F.col("digest"), "corrupt").otherwise("ok")
    return found.select("digest", F.when(state == "ok", F.col("content")).alias("content"), state.alias("state"))


def corrupt_blobs(spark: SparkSession, path: str) -> DataFrame:
    """Blobs whose bytes no longer have the hash that names them."""
    return inventory(spark, path).where(F.col("name") != F.col("content_hash"))


def text_sources(spark: SparkSession, path: str) -> DataFrame:
    """Text files as UTF-8 where they are, else as Latin-1; the source is the content's hash."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    utf8 = F.try_validate_utf8(F.col("content").cast("string"))
    text = F.coalesce(utf8, F.decode("content", "ISO-8859-1"))
    return files.where(format_kind(name) == "txt").select(F.sha2("content", 256).alias("source_ref"), F.col("path").alias("external_ref"), text.alias("text"))


def pdf_units(spark: SparkSession, path: str) -> DataFrame:
    """Paragraphs of PDF pages, or a status where no parser is installed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf").load(path)

    def extract(batches):
        import io

        import pandas as pd

        try:
            from pypdf import PdfReader
        except ImportError:
            PdfReader = None
        for frame in batches:
            rows = []
            for ref, content in zip(frame["path"], frame["content"], strict=True):
                if PdfReader is None:
                    rows.append((ref, None, None, None, "parser_unavailable"))
                    continue
                try:
                    pages = [p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages]
                except Exception:  # noqa: BLE001 - a broken file is a status, not a failed job
                    rows.append((ref, None, None, None, "corrupt_source"))
                    continue
                found = [(ref, n, k, part.strip(), "ok") for n, text in enumerate(pages, 1) for k, part in enumerate(text.split("\n\n")) if part.strip()]
                rows += found or [(ref, None, None, None, "unsupported_format")]
            yield pd.DataFrame(rows, columns=["source_ref", "page", "unit_order", "text", "status"])

    return files.select("path", "content").mapInPandas(extract, "source_ref string, page int, unit_order int, text string, status string")
