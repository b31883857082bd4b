"""Reproducible outputs: sorted gzipped lists named by their content, manifests, append-only records, reports."""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import tempfile
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.functions import keys


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a file to any file system Spark knows, under a temporary name first."""
    write_stream(spark, path, io.BytesIO(data))


def write_stream(spark: SparkSession, path: str, source: BinaryIO, block: int = 1 << 22) -> None:
    """Write what *source* holds, block by block; the target is replaced by one rename, so it is never absent."""
    fs, temporary = _fs(spark, f"{path}.tmp")
    out = fs.create(temporary, True)
    while data := source.read(block):
        out.write(bytearray(data))
    out.close()
    overwrite = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(overwrite, 1)
    how[0] = overwrite.OVERWRITE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(temporary), fs.makeQualified(_fs(spark, path)[1]), how)


def cite_list(rows: DataFrame, folder: str, generated: str, header: str = "#cite-index 1") -> dict:
    """The list as one gzipped TSV, sorted by bytes, its digest in its name; the manifest is written last.

    Sorting is distributed; the sorted lines stream through the driver one partition at a time, because the format
    is a single file.
    """
    spark = rows.sparkSession
    line = F.concat_ws("\t", "key", "court", "canton", "date", F.array_join("enums", ","), keys.clean_field(F.col("id")))
    ordered = rows.orderBy("key", "court", "canton", "date").select(line.alias("line"))
    plain, count = len(header.encode()) + 1, 0
    # The packed list lies in a file of the driver until its digest, and so its name, is known.
    with tempfile.TemporaryFile() as packed:
        with gzip.GzipFile(filename="", mode="wb", fileobj=packed, compresslevel=9, mtime=0) as out:
            out.write(f"{header}\n".encode())
            for row in ordered.toLocalIterator():
                raw = f"{row[0]}\n".encode()
                out.write(raw)
                plain, count = plain + len(raw), count + 1
        size = packed.tell()
        packed.seek(0)
        digest = hashlib.file_digest(packed, "sha256").hexdigest()
        name = f"cite-index-{generated[:10]}-{digest[:8]}.tsv.gz"
        packed.seek(0)
        write_stream(spark, f"{folder}/{name}", packed)
    manifest = {"schema": 1, "file": name, "bytes": size, "sha256": digest, "unpacked_bytes": plain, "generated": generated, "labels": count}
    write_bytes(spark, f"{folder}/index.json", (json.dumps(manifest, ensure_ascii=False, indent=1) + "\n").encode())
    fs, at = _fs(spark, folder)
    for status in fs.listStatus(at):
        found = status.getPath().getName()
        if found.startswith("cite-index-") and found.endswith(".tsv.gz") and found != name:
            fs.delete(status.getPath(), False)
    return manifest


def vocabulary_list(decided: DataFrame, folder: str, header: str = "#vocabulary 1") -> None:
    """Words with their marks (``~``, ``^``, ``!``), sorted by bytes, as gzipped text in range-ordered parts."""
    words = decided.where("verdict IN ('acronym', 'word', 'name_as_word')").select(F.col("word").alias("value"))
    marked = decided.where("mark <> ''").select(F.concat("mark", "word").alias("value"))
    head = decided.sparkSession.createDataFrame([(header,)], "value string")
    head.unionByName(words.unionByName(marked).orderBy("value")).write.mode("overwrite").option("compression", "gzip").text(folder)


def input_version(df: DataFrame) -> str:
    """A digest of names, sizes and times of the files that *df* reads; it changes when they do."""
    digest = hashlib.sha256()
    for name in sorted(df.inputFiles()):
        fs, at = _fs(df.sparkSession, name)
        status = fs.getFileStatus(at)
        digest.update(f"{name} {status.getLen()} {status.getModificationTime()}\n".encode())
    return digest.hexdigest()


def _text(spark: SparkSession, path: str) -> str | None:
    fs, at = _fs(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def kept(df: DataFrame, path: str, version: str | None = None) -> DataFrame:
    """*df* as it was written under *path*; it is computed and written if nothing is there or its *version* has changed.

    The version is :func:`input_version` unless one is given; it is written after the table, so that a writer that is
    killed leaves a table that the next one replaces.
    """
    spark = df.sparkSession
    version = input_version(df) if version is None else version
    fs, done = _fs(spark, f"{path}/_SUCCESS")
    if not fs.exists(done) or _text(spark, f"{path}.version") != version:
        df.write.mode("overwrite").parquet(path)
        write_bytes(spark, f"{path}.version", version.encode())
    return spark.read.parquet(path)


def markdown(rows: list, columns: list[str]) -> str:
    """A small result as a Markdown table."""
    lines = [f"| {' | '.join(columns)} |", f"|{'---|' * len(columns)}"]
    return "\n".join(lines + [f"| {' | '.join(str(r[c]) for c in columns)} |" for r in rows]) + "\n"
