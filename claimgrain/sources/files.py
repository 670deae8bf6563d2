"""Files in and out: landing folders, id lists, chunk tables, edge and audit exports.

Each reader is split into the read and a shaping function on ``(path, value)`` or row
tables, so the shaping also works on tables that never were files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimgrain import dims
from claimgrain.functions import ids
from claimgrain.functions.text import strip_blank
from claimgrain.operators.knowledge import TRIPLE_SCHEMA, parse_array

CHUNK_SCHEMA = ("chunk_id string, document_id string, source_type string, source_name string, "
                "source_url string, acquired_at string, published_at string, "
                "evidence_tier_default int, jurisdiction string, content_hash string, "
                "content string, chunk_index int")
_BASENAME = r"([^/]+)$"


def whole_files(spark: SparkSession, folder: str) -> DataFrame:
    """``path, value`` of every file in a folder. Spark skips names starting with ``.`` or
    ``_``; bytes that are not UTF-8 are replaced on decoding."""
    return (spark.read.text(folder, wholetext=True)
            .select(F.col("_metadata.file_path").alias("path"), "value"))


def with_stem(files: DataFrame) -> DataFrame:
    name = F.regexp_extract("path", _BASENAME, 1)
    return (files.withColumn("name", name)
            .withColumn("extension", F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)))
            .withColumn("stem", F.regexp_replace("name", r"(?<=.)\.[^.]+$", "")))


def document_files(files: DataFrame, extensions: list[str] | None = None) -> DataFrame:
    """Text documents with an allowed extension and some content."""
    allowed = extensions or [e for e in dims.DOCUMENT_EXTENSIONS if e != "pdf"]
    return (with_stem(files)
            .filter(F.col("extension").isin(allowed) & ~F.col("name").startswith("."))
            .filter(strip_blank(F.col("value")) != "")
            .select(F.lit("document").alias("source_type"), F.col("stem").alias("source_name"),
                    F.lit(None).cast("string").alias("source_url"), F.lit(2).alias("evidence_tier"),
                    F.col("path").alias("file_path"), F.col("value").alias("raw_content")))


def id_list(lines: DataFrame) -> DataFrame:
    """Registered values: blank and comment lines dropped, trailing labels split off."""
    return (lines.withColumn("line", strip_blank(F.col("value")))
            .filter((F.col("line") != "") & ~F.col("line").startswith("#"))
            .withColumn("value", F.get(F.split("line", r"\s+#\s*", 2), F.lit(0)))
            .withColumn("label", F.get(F.split("line", r"\s+#\s*", 2), F.lit(1)))
            .drop("line"))


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    return id_list(spark.read.text(path))


def landing_files(spark: SparkSession, folder: str) -> DataFrame:
    """Path and size of landed files; contents are not read."""
    return (spark.read.format("binaryFile").load(folder)
            .select("path", F.col("length").alias("size_bytes")))


def validate_landing(files: DataFrame, max_bytes: int = dims.MAX_UPLOAD_BYTES) -> DataFrame:
    """Accepted or rejected, with the reason."""
    named = with_stem(files)
    bad_type = ~F.col("extension").isin(dims.DOCUMENT_EXTENSIONS)
    suffix = F.when(F.col("extension") != "", F.concat(F.lit("."), F.col("extension"))).otherwise("")
    reason = (F.when(bad_type, F.concat(F.lit("Unsupported extension '"), suffix, F.lit("'")))
              .when(F.col("size_bytes") > max_bytes, "File exceeds 50 MB limit"))
    return named.select("path", "name", "size_bytes", reason.isNull().alias("accepted"),
                        reason.alias("reason"))


def write_chunks(chunks: DataFrame, path: str, fmt: str = "parquet", mode: str = "append") -> None:
    """Chunk table partitioned by source type. Rebalancing gives files of the advisory size:
    small types share tasks, a type with most of the rows is split over many."""
    (chunks.hint("rebalance", "source_type")
     .write.mode(mode).partitionBy("source_type").format(fmt).save(path))


def chunk_json(chunks: DataFrame) -> DataFrame:
    """Chunks as JSON documents: flat fields and the nested ``metadata`` record."""
    meta = ["source_type", "source_name", "source_url", "acquired_at", "published_at",
            "evidence_tier_default", "jurisdiction", "content_hash", "document_id", "chunk_id"]
    flat = ["chunk_id", "document_id", "source_type", "source_name", "source_url", "acquired_at",
            "published_at", "evidence_tier_default", "jurisdiction", "content_hash", "content",
            "chunk_index"]
    stamps = {f.name for f in chunks.schema.fields if "timestamp" in f.dataType.simpleString()}
    chunks = chunks.withColumns({c: ids.isoformat(F.col(c)) for c in flat if c in stamps})
    return chunks.select(F.to_json(F.struct(*flat, F.struct(*meta).alias("metadata")),
                                   {"ignoreNullFields": "false"}).alias("value"))


_NEEDED = ("chunk_id", "document_id", "content")


def load_chunks(lines: DataFrame) -> DataFrame:
    """Chunk JSON values to typed rows with defaults; rows without the key fields are left out
    (``rejected_chunks`` lists them)."""
    return _typed(lines.select(F.from_json("value", CHUNK_SCHEMA).alias("c")).select("c.*"))


def _typed(parsed: DataFrame) -> DataFrame:
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    optional = lambda c, kind: F.col(c) if c in parsed.columns else F.lit(None).cast(kind)
    rows = parsed.withColumn("jurisdiction", optional("jurisdiction", "string"))
    return (rows.filter(F.col("chunk_id").isNotNull() & F.col("document_id").isNotNull()
                        & F.col("content").isNotNull())
            .select("chunk_id", "document_id",
                    F.coalesce("source_type", F.lit("unknown")).alias("source_type"),
                    F.coalesce("source_name", F.lit("unknown")).alias("source_name"),
                    blank("source_url").alias("source_url"),
                    F.coalesce(F.col("acquired_at").try_cast("timestamp_ntz"),
                               F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
                    .alias("acquired_at"),
                    F.col("published_at").try_cast("timestamp_ntz").alias("published_at"),
                    F.coalesce(F.col("evidence_tier_default").cast("int"), F.lit(3))
                    .alias("evidence_tier"),
                    blank("jurisdiction").alias("jurisdiction"),
                    F.coalesce("content_hash", F.lit("")).alias("content_hash"), "content",
                    F.coalesce(F.col("chunk_index").cast("int"), F.lit(0)).alias("chunk_index")))


def read_chunks(spark: SparkSession, folder: str, fmt: str = "parquet") -> DataFrame:
    """A chunk table as ``write_chunks`` leaves it, all rows of all files, with the type taken
    from the partition folders."""
    reader = spark.read if fmt == "parquet" else spark.read.schema(CHUNK_SCHEMA)
    rows = reader.format(fmt).load(folder)
    tier = "evidence_tier_default" if "evidence_tier_default" in rows.columns else "evidence_tier"
    return _typed(rows.withColumnRenamed(tier, "evidence_tier_default"))


def read_chunk_lines(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """JSON lines, many per file: the chunks, and the rejected lines with file and reason."""
    lines = spark.read.text(folder).select("value", F.col("_metadata.file_path").alias("path"))
    return load_chunks(lines), rejected_chunks(lines)


def read_chunk_documents(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """One JSON document per file, over several lines: chunks and rejected files."""
    whole = whole_files(spark, folder)
    return load_chunks(whole), rejected_chunks(whole)


def rejected_chunks(lines: DataFrame) -> DataFrame:
    """Non-blank values that ``load_chunks`` leaves out, each with the reason."""
    parsed = lines.filter(strip_blank(F.col("value")) != "").withColumn(
        "c", F.from_json("value", CHUNK_SCHEMA + ", _corrupt_record string",
                         {"columnNameOfCorruptRecord": "_corrupt_record"}))
    missing = F.concat_ws(", ", *[F.when(F.col(f"c.{k}").isNull(), k) for k in _NEEDED])
    reason = F.when(F.col("c").isNull() | F.col("c._corrupt_record").isNotNull(), "not a JSON object").when(
        missing != "", F.concat(F.lit("missing: "), missing))
    return parsed.withColumn("reason", reason).filter("reason IS NOT NULL").drop("c")


def load_triples(files: DataFrame) -> DataFrame:
    """Triple files (array or single object) to rows; broken files give none. The order of
    rows is file name, then position."""
    return (files.select("path", F.posexplode(parse_array(strip_blank(F.col("value")),
                                                          TRIPLE_SCHEMA)).alias("position", "t"))
            .select(F.struct("path", "position").alias("seq"), "t.*",
                    F.lit(None).cast("string").alias("source_chunk_id")))


def write_edges(edges: DataFrame, path: str) -> None:
    from claimgrain.operators.graph import edge_lines
    edge_lines(edges).write.mode("overwrite").text(path)


def write_audit_csv(events: DataFrame, path: str) -> None:
    from claimgrain.operators.audit import csv_rows
    csv_rows(events).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
