"""Tables kept by key: documents with chunks, claims, entities in YAML, knowledge graphs and old batch states in JSON."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curatrix.functions.vectors import unit


def upsert(current: DataFrame, incoming: DataFrame, key: str, version: str | None = None) -> DataFrame:
    """current with incoming rows in place of those of the same key; of repeated incoming keys the highest version stays.

    Without a version, repeated keys keep their largest row, so the result doesn't depend on the order.
    """
    order = [F.desc(version)] if version else []
    rest = [F.desc(F.to_json(F.struct(*incoming.columns)))]
    new = incoming.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order, *rest))).where("_n = 1").drop("_n")
    return current.join(new.select(key), key, "left_anti").unionByName(new)


def latest(rows: DataFrame, key: str, version: str) -> DataFrame:
    """The row of highest version of each key; ties by the rest of the row."""
    line = Window.partitionBy(key).orderBy(F.desc(version), F.desc(F.to_json(F.struct(*rows.columns))))
    return rows.withColumn("_n", F.row_number().over(line)).where("_n = 1").drop("_n")


def stale(files: DataFrame, known: DataFrame) -> DataFrame:
    """files(path, mtime) that known(path, mtime) lacks or has with another time."""
    old = known.select("path", F.col("mtime").alias("_m"))
    return files.join(old, "path", "left").where(F.coalesce(F.col("mtime") != F.col("_m"), F.lit(True))).drop("_m")


def file_times(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, mtime) of the files below folder; their contents aren't read."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    return df.select("path", (F.unix_micros("modificationTime") / 1e6).alias("mtime"))


def add_documents(documents: DataFrame, chunks: DataFrame, incoming: DataFrame, incoming_chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, chunks) after ingest: unchanged (path, mtime) are passed over, others replace the document and all its chunks."""
    fresh = stale(incoming, documents)
    docs = upsert(documents, fresh, "path", "mtime")
    paths = fresh.select(F.col("path").alias("doc_path")).distinct()
    new = incoming_chunks.join(paths, "doc_path", "left_semi")
    return docs, chunks.join(paths, "doc_path", "left_anti").unionByName(new)


def add_claims(chunks: DataFrame, claims: DataFrame) -> DataFrame:
    """chunks with claims(id, content, ...) under the key claim:<id>; a claim always replaces its former text."""
    rows = claims.withColumn("doc_path", F.concat(F.lit("claim:"), F.col("id").cast("string"))).drop("id")
    return upsert(chunks, rows.select(*[c for c in chunks.columns if c in rows.columns], *[F.lit(None).cast(chunks.schema[c].dataType).alias(c) for c in chunks.columns if c not in rows.columns]), "doc_path")


def index_stats(chunks: DataFrame) -> DataFrame:
    """One row: chunks, documents, collections (sorted) and embedded chunks."""
    return chunks.agg(F.count("*").alias("chunks"), F.count_distinct("doc_path").alias("documents"), F.sort_array(F.collect_set("collection")).alias("collections"), F.count("embedding").alias("embedded"))


def vectors_of(chunks: DataFrame, collection: str | None = None) -> DataFrame:
    """(id, vec) of embedded chunks, of length 1; one collection or all."""
    rows = chunks.where("embedding is not null")
    rows = rows if collection is None else rows.where(F.col("collection") == collection)
    return rows.select("id", unit(F.col("embedding")).alias("vec"))


def read_entities(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """One row for each YAML file below folder, in the given schema plus path; unreadable files are left out."""
    names = [f.name for f in spark.createDataFrame([], schema).schema]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for pdf in batches:
            rows = []
            for path, content in zip(pdf.path, pdf.content, strict=True):
                try:
                    data = yaml.safe_load(bytes(content).decode("utf-8"))
                except (yaml.YAMLError, UnicodeDecodeError):
                    continue
                if isinstance(data, dict):
                    rows.append({**{n: data.get(n) for n in names}, "path": path})
            yield pd.DataFrame(rows, columns=[*names, "path"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.y*ml").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "content").mapInPandas(parse, f"{schema}, path string")


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """Nodes of a knowledge graph in JSON, {"nodes": [...]} or a bare list."""
    node = "struct<id:string,title:string,description:string,level:int,obscurity:int,prerequisites:array<string>>"
    text = spark.read.text(path, wholetext=True)
    bare = F.trim(F.translate("value", "\n\r\t", "   ")).startswith("[")
    whole = F.when(bare, F.concat(F.lit('{"nodes":'), F.col("value"), F.lit("}"))).otherwise(F.col("value"))
    return text.select(F.from_json(whole, f"struct<nodes:array<{node}>>").alias("g")).select(F.explode("g.nodes").alias("n")).select("n.*")


def read_old_state(spark: SparkSession, path: str) -> DataFrame:
    """(item_id, status, cost) of a JSON batch state that maps ids to items, under "items" or "productions"."""
    item = "map<string,struct<status:string,cost:double>>"
    parsed = F.from_json("value", f"struct<items:{item},productions:{item}>")
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.coalesce(parsed["items"], parsed["productions"])).alias("item_id", "i"))
    return rows.select("item_id", F.coalesce("i.status", F.lit("pending")).alias("status"), F.coalesce("i.cost", F.lit(0.0)).alias("cost"))
