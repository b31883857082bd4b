"""Sources of decisions and texts: court-wise Parquet, a filling second store, text, names, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DECISION_COLUMNS = ("decision_id", "court", "canton", "decision_date", "docket_number", "docket_number_2", "canonical_decision_id")
ALIAS_SCHEMA = "alias_docket_norm string, canonical_decision_id string"


def not_beginning(prefix: str) -> str:
    """A path pattern for names that do not begin with *prefix*: one alternative for each place at which they differ."""
    return "{" + ",".join(f"{prefix[:k]}[^{prefix[k]}]*" for k in range(len(prefix))) + "}"


def court_files(spark: SparkSession, folder: str, columns: tuple[str, ...] = DECISION_COLUMNS) -> DataFrame:
    """Per-court Parquet files with the columns asked for (absent ones null) and the file name; hidden and delta files left out."""
    df = spark.read.option("mergeSchema", "true").option("pathGlobFilter", not_beginning("delta-")).parquet(folder)
    name = F.regexp_extract(F.col("_metadata.file_path"), "[^/]+$", 0)
    return df.select(*[F.col(c).cast("string").alias(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns], name.alias("file"))


def rotated_logs(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """value of all lines of a log and its rotated generations (any suffix, plain or gzipped) in *folder*.

    Other files are pruned by their paths and never opened. A gzipped generation is read by one task, as its format wants.
    """
    return spark.read.text(f"{folder}/{name}*")


def record_rows(lines: DataFrame, text: str = "value") -> DataFrame:
    """day, downloads, unique, bots of a tab-separated record; rows of the old form have no bots, which are null then.

    Headers of either form, empty lines and lines without a day are left out; of rows of one day the first form that
    counts bots stays, then the larger count.
    """
    parts = F.split(F.rtrim(F.col(text)), "\t")
    number = lambda i: F.try_to_number(F.get(parts, i), F.lit("999999999999")).cast("long")
    rows = lines.select(F.get(parts, 0).alias("day"), number(1).alias("downloads"), number(2).alias("unique"), number(3).alias("bots"))
    rows = rows.where(F.col("day").rlike(r"^\d{4}-\d{2}-\d{2}$") & F.col("downloads").isNotNull())
    best = F.max(F.struct(F.col("bots").isNotNull().alias("whole"), "downloads", "unique", "bots")).alias("r")
    return rows.groupBy("day").agg(best).select("day", "r.downloads", "r.unique", "r.bots")


def gap_filled(first: DataFrame, second: DataFrame, by: str) -> DataFrame:
    """All rows of *first*, and those of *second* whose *by* value the first has not at all."""
    missing = second.join(first.select(by).distinct(), by, "left_anti").select(*first.columns)
    return first.unionByName(missing)


def table_or_empty(spark: SparkSession, name: str, schema: str = ALIAS_SCHEMA) -> DataFrame:
    """A catalogued table, or an empty one of *schema* if it does not exist."""
    return spark.table(name) if spark.catalog.tableExists(name) else spark.createDataFrame([], schema)


def pack(spark: SparkSession, url: str, name: str, driver: str = "org.sqlite.JDBC") -> DataFrame:
    """A table of a read-only pack over JDBC; needs the driver's jar on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, driver=driver).load()


def with_identity(df: DataFrame, text: str = "text", candidates: tuple[str, ...] = ("decision_id", "id", "doc_id")) -> DataFrame:
    """*df* with ``identity``: the first id column it has, else (or where that is null) the first 200 characters of its text."""
    start = F.substring(text, 1, 200)
    found = next((c for c in candidates if c in df.columns), None)
    return df.withColumn("identity", F.coalesce(F.col(found).cast("string"), start) if found else start)


def paragraphs(df: DataFrame, key: str, text: str = "text", separator: str = "\n+") -> DataFrame:
    """key, paragraph, text: pasted text cut at line breaks."""
    return df.select(key, F.posexplode(F.split(text, separator)).alias("paragraph", "text"))


def _numbered(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Lines (file, block, seq, text) of text files, and first seq and number of lines of each block.

    Numbers that rise within a task are consecutive within a block of a file, which one task reads from start to end.
    """
    rows = spark.read.option("lineSep", "\n").text(path)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), F.regexp_replace("value", r"\r$", "").alias("text"))
    return rows, rows.groupBy("file", "block").agg(F.min("seq").alias("first"), F.count("*").alias("n"), F.min_by("text", "seq").alias("head"))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, paragraph, text of plain text files, one paragraph a line, counted from 0 in each file.

    A file may be read by many tasks: the lines of the blocks before are added to a line's number in its block.
    """
    rows, blocks = _numbered(spark, path)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).select("file", "block", "first", "offset")
    met = rows.join(blocks, ["file", "block"])
    return met.select("file", (F.col("offset") + F.col("seq") - F.col("first")).cast("int").alias("paragraph"), "text")


def surname_csv(spark: SparkSession, path: str) -> DataFrame:
    """name, bearers of a residents' CSV list with a byte-order mark and a header; rows of the whole country."""
    df = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    name = "LASTNAME" if "LASTNAME" in df.columns else "FIRSTNAME"
    return df.where("VALUE IS NOT NULL").groupBy(F.col(name).alias("name")).agg(F.sum(F.col("VALUE").cast("long")).alias("bearers"))


def quoted_labels(spark: SparkSession, path: str) -> DataFrame:
    """name: labels written ``"x"@lang``, one a line."""
    return spark.read.text(path).select(F.regexp_extract("value", r'^"(.*)"@[a-z\-]+$', 1).alias("name")).where("name <> ''")


def headed_tsv(spark: SparkSession, path: str, header: str, columns: tuple[str, ...]) -> DataFrame:
    """Rows of a (gzipped) TSV list of which each file's first line must be *header*; lines that start with # are never data."""
    lines, blocks = _numbered(spark, path)
    wrong = blocks.groupBy("file").agg(F.min_by("head", "block").alias("head")).where(~F.col("head").eqNullSafe(F.lit(header)))
    if lines.limit(1).count() == 0 or wrong.limit(1).count():
        raise ValueError(f"{path} does not start with {header!r}")
    rows = lines.select(F.col("text").alias("value"))
    parts = F.split("value", "\t")
    return rows.where(~F.col("value").startswith("#")).select(*[F.get(parts, i).alias(c) for i, c in enumerate(columns)])


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A one-row manifest, checked: schema 1, a 64-digit checksum, a plain file name; anything else raises when read."""
    df = spark.read.option("multiLine", True).json(path)
    good = (F.col("schema") == 1) & F.col("sha256").rlike("^[0-9a-f]{64}$") & F.col("file").rlike(r"^[A-Za-z0-9._-]+$") & ~F.col("file").contains("..")
    return df.withColumn("schema", F.when(F.coalesce(good, F.lit(False)), F.col("schema")).otherwise(F.raise_error(F.lit("not a valid manifest")).cast("long")))


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """doc, annotator, entity_id, identifier_type, entity_type, start, text: one row for each mention of an annotated set."""
    mention = "array<struct<entity_id:string,identifier_type:string,entity_type:string,span_text:string,start_offset:int>>"
    schema = f"doc_id string, text string, annotations map<string,struct<entity_mentions:{mention}>>"
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    rows = df.select("doc_id", F.explode("annotations").alias("annotator", "a")).select("doc_id", "annotator", F.explode("a.entity_mentions").alias("m"))
    return rows.select("doc_id", "annotator", "m.entity_id", "m.identifier_type", "m.entity_type", F.col("m.start_offset").alias("start"), F.col("m.span_text").alias("text"))
