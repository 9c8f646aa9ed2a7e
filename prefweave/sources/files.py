"""Sources and sinks: JSON lines, JSON documents, chunked arrays, archives, newest files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefweave.operators.order import with_position


def read_jsonl(spark: SparkSession, path: str, schema: str, limit: int | None = None, index: str = "row_index") -> DataFrame:
    """JSON lines with a schema; the rows before ``limit`` by their index."""
    df = spark.read.schema(schema).json(path)
    return df if limit is None else df.where(F.col(index) < limit)


def read_prefix(spark: SparkSession, path: str, schema: str, expected: int, index: str = "row_index") -> DataFrame:
    """The first ``expected`` rows of a log, which must be there without gap or repeat."""
    df = read_jsonl(spark, path, schema, expected, index)
    n, distinct, last = df.agg(F.count(index), F.count_distinct(index), F.max(index)).first()
    if (n, distinct, last) != (expected, expected, expected - 1 if expected else None):
        raise ValueError(f"the log isn't a gapless prefix of {expected} rows")
    return df


def write_jsonl(df: DataFrame, path: str, order: str | None = None, mode: str = "overwrite", one_file: bool = False) -> None:
    """JSON lines with explicit nulls, committed as a whole; in order if asked.

    Ordered files follow each other by name; ``one_file`` is for small results only.
    """
    out = df.orderBy(order) if order else df
    if one_file:
        out = out.coalesce(1)
    out.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_with_prefix(df: DataFrame, whole: str, prefix: str, size: int, index: str = "row_index") -> None:
    """The full set and its first ``size`` rows, from one computation."""
    df = df.persist()
    try:
        df.write.mode("overwrite").parquet(whole)
        df.where(F.col(index) < size).write.mode("overwrite").parquet(prefix)
    finally:
        df.unpersist()


def metadata(spark: SparkSession, **fields: object) -> DataFrame:
    """One row with the fields as a JSON object; a field may be a one-row frame of figures."""
    frames = {k: v for k, v in fields.items() if isinstance(v, DataFrame)}
    out = spark.range(1).select(*(F.lit(v).alias(k) if not isinstance(v, dict) else F.struct(*(F.lit(x).alias(n) for n, x in v.items())).alias(k) for k, v in fields.items() if k not in frames))
    for k, f in frames.items():
        out = out.join(F.broadcast(f.limit(1).select(F.struct("*").alias(k))), how="cross")
    return out.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def write_reports(reports: dict[str, DataFrame], folder: str) -> None:
    """Each report as JSON lines in a folder of its name."""
    for name, df in reports.items():
        write_jsonl(df, f"{folder}/{name}")


def write_chunks(df: DataFrame, path: str, chunk: int, index: str = "row_index") -> None:
    """Parquet partitioned by ``chunk_idx``, so many successive rows in each."""
    df.withColumn("chunk_idx", F.floor(F.col(index) / chunk).cast("int")).repartition("chunk_idx").write.mode("overwrite").partitionBy("chunk_idx").parquet(path)


def read_chunks(spark: SparkSession, path: str, chunks: list[int] | None = None) -> DataFrame:
    """All chunks, or only the folders of some."""
    df = spark.read.parquet(path)
    return df if chunks is None else df.where(F.col("chunk_idx").isin(chunks))


def chunk_faults(df: DataFrame, chunk: int, index: str = "row_index") -> DataFrame:
    """Chunks other than the last that don't hold exactly ``chunk`` rows, or that hold rows of another."""
    per = df.groupBy("chunk_idx").agg(F.count(F.lit(1)).alias("n"), F.min(index).alias("a"), F.max(index).alias("b"))
    last = per.agg(F.max("chunk_idx").alias("last"))
    bad = ((F.col("n") != chunk) & (F.col("chunk_idx") != F.col("last"))) | (F.col("n") > chunk) | (F.floor(F.col("a") / chunk) != F.col("chunk_idx")) | (F.floor(F.col("b") / chunk) != F.col("chunk_idx"))
    return per.crossJoin(F.broadcast(last)).where(bad).select("chunk_idx", "n")  # one row


def work_plan(df: DataFrame, chunk: int, done: DataFrame | None = None, index: str = "row_index") -> DataFrame:
    """(chunk_idx, state): which chunks are completed and which are to do."""
    every = df.select(F.floor(F.col(index) / chunk).cast("int").alias("chunk_idx")).distinct()
    if done is None:
        return every.withColumn("state", F.lit("to_do"))
    return every.join(done.select("chunk_idx").distinct().withColumn("_d", F.lit(True)), "chunk_idx", "left").select("chunk_idx", F.when(F.col("_d"), "completed").otherwise("to_do").alias("state"))


def direction(df: DataFrame, layer: int | None = None, name: str | None = None) -> list[float]:
    """A direction from a table (name, layer, vector) of any of three layouts.

    A plain vector has a null layer; stacked ones lie one row later than their layer, the
    embedding layer being first (``layer`` is then ``layer + 1``); one with its own layer must match.
    """
    own = df if name is None else df.where(F.col("name") == name)
    rows = own.where(F.col("layer").isNull() | (F.col("layer") == layer) if layer is not None else F.lit(True)).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{'no' if not rows else 'more than one'} vector for layer {layer}")
    return list(rows[0]["vector"])


def stacked(vectors: list[list[float]], layer: int) -> list[float]:
    """The vector of a layer in a stack that begins with the embedding layer."""
    if not 0 <= layer + 1 < len(vectors):
        raise ValueError(f"layer {layer} isn't in a stack of {len(vectors)}")
    return vectors[layer + 1]


def read_archives(spark: SparkSession, path: str | list[str], glob: str = "*.eval", members: str = "samples/") -> DataFrame:
    """(path, member, text) of the JSON members of zip archives, in the members' order; of all below a folder, or of a list of files."""
    return archive_members(spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path), members)


def archive_members(files: DataFrame, members: str = "samples/") -> DataFrame:
    """(path, member, text) from rows (path, content) of zip archives."""

    def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = sorted(n for n in z.namelist() if n.startswith(members) and n.endswith(".json"))
                    for n in names:
                        yield pd.DataFrame({"path": [p], "member": [n], "text": [z.read(n).decode()]})

    return files.select("path", "content").mapInPandas(unzip, "path string, member string, text string")


def newest(spark: SparkSession, path: str, glob: str = "*.eval") -> DataFrame:
    """(folder, path, modified): the newest file of each folder; of equals the last by path."""
    return newest_of(spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "modificationTime"))


def newest_of(listing: DataFrame, inside: str | None = None) -> DataFrame:
    """(folder, path, modified) from rows (path, modificationTime): the newest file of each folder.

    With ``inside`` only files in a subfolder of that name count, for the folder above it; so
    folders that lack it are left out. A folder is known by its name.
    """
    parts = F.split("path", "/")
    own = listing.withColumn("folder", F.element_at(parts, -2 if inside is None else -3))
    if inside is not None:
        own = own.where(F.element_at(parts, -2) == inside)
    return own.groupBy("folder").agg(F.max(F.struct("modificationTime", "path")).alias("m")).select("folder", F.col("m.path").alias("path"), F.col("m.modificationTime").alias("modified"))


def read_newest_archives(spark: SparkSession, path: str, inside: str, glob: str = "*.eval", members: str = "samples/") -> DataFrame:
    """(folder, path, member, text): the members of each folder's newest archive; a path without any is an error."""
    listing = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "modificationTime")
    found = newest_of(listing, inside)
    paths = [r["path"] for r in found.select("path").collect()]  # one for each evaluated model
    if not paths:
        raise FileNotFoundError(f"no {glob} in a folder {inside} under {path}")
    return read_archives(spark, paths, glob, members).join(F.broadcast(found.select("folder", "path")), "path").select("folder", "path", "member", "text")


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of files that hold one JSON array each, with the key of sample and epoch."""
    from prefweave.functions.text import episode_key

    df = spark.read.schema(schema).option("multiLine", "true").json(path)
    return df.withColumn("key", episode_key(F.col("id"), F.col("epoch")))


def read_transcripts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON files with the name of each row's file and folder."""
    df = spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").json(path)
    file = F.col("_metadata.file_path")
    return df.select("*", F.element_at(F.split(file, "/"), -1).alias("file_name"), F.element_at(F.split(file, "/"), -2).alias("checkpoint"))


def first_n(df: DataFrame, order: list, n: int) -> DataFrame:
    """The first ``n`` rows in an order, or all if there are fewer, with ``row_index``."""
    return with_position(df.orderBy(*order).limit(n), order, "row_index")
