"""Reading inputs and tables, and writing what is delivered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import normalise as N
from docloom.operators.catalogue import chamber_dir
from docloom.sources.snapshots import SnapshotStore


def with_doc_ids(files: DataFrame, root: str = "", extensions: tuple[str, ...] = ("pdf", "docx", "doc")) -> DataFrame:
    """doc_id and ext of each path: the relative path without its extension, which is kept where two files share a stem. Lock files are skipped."""
    rel = F.regexp_replace("path", "^(file:)?" + root.rstrip("/").replace("file:", "") + "/", "") if root else F.col("path")
    split = files.withColumns({"_rel": rel, "ext": F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))})
    split = split.where(F.col("ext").isin(*extensions) & ~F.col("path").rlike(r"(^|/)~\$[^/]*$")).withColumn("_stem", F.regexp_replace("_rel", r"\.[^./]+$", ""))
    shared = split.groupBy("_stem").agg(F.count("*").alias("_n"))
    return split.join(shared, "_stem").withColumn("doc_id", F.when(F.col("_n") > 1, F.concat_ws("_", "_stem", "ext")).otherwise(F.col("_stem"))).drop("_rel", "_stem", "_n")


def discover_inputs(spark: SparkSession, root: str, extensions: tuple[str, ...] = ("pdf", "docx", "doc")) -> DataFrame:
    """doc_id, ext, path, length, modificationTime and content of all files under a folder."""
    return with_doc_ids(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root), root, extensions)


def fingerprint(content: Column | str) -> Column:
    """The MD5 of a file's bytes."""
    return F.md5(content)


RECORD = """doc_id string, source_file string, format string, read_method string, level string, case_id string, review string,
fields map<string,struct<value:string,raw:string,confidence:double,source:string>>, category struct<value:string,source:string>,
links array<struct<to:string,role:string,confidence:string>>, pii struct<removed_count:int,types:array<string>>,
leak_test struct<passed:boolean,hits:int,leaked_count:int>, cost struct<calls:int,input_tokens:bigint,output_tokens:bigint,usd:double>,
anonymized_file string, file_path string, quarantined boolean, quarantine_reason string, pages int, status string, city string, year string"""


def load_records(spark: SparkSession, path: str) -> DataFrame:
    """Nested records; keys that a record lacks are null."""
    return spark.read.schema(RECORD).json(path, multiLine=True)


def load_truth(spark: SparkSession, path: str) -> DataFrame:
    """Annotated truth, one JSON object keyed by doc_id, as rows."""
    entry = "struct<format:string,chamber:string,level:string,fields:map<string,string>,pii:array<string>,kept_terms:array<string>,links:array<string>>"
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string,{entry}>")).alias("doc_id", "t")).select("doc_id", "t.*")


def load_edits(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    return spark.read.schema("doc_id string, " + ", ".join(f"{f} string" for f in fields)).json(path, multiLine=True)


def write_records(records: DataFrame, path: str) -> None:
    """One JSON record per document, sorted by id over all files."""
    records.orderBy("doc_id").write.json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header. No byte order mark: part files are concatenated by readers that would see it as data."""
    df.write.option("header", True).csv(path)


def write_by_chamber(df: DataFrame, path: str, chamber: str = "category") -> None:
    """Parquet in a folder for each chamber."""
    df.withColumn("chamber_dir", chamber_dir(chamber)).write.partitionBy("chamber_dir").parquet(path)


def write_enrichment(df: DataFrame, path: str) -> None:
    df.write.option("compression", "gzip").json(path)


def read_table(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """A stored table with later columns added as empty strings or zeros."""
    df = spark.read.option("mergeSchema", True).parquet(path)
    missing = {c: (F.lit("") if kind == "string" else F.lit(0)).cast(kind) for c, kind in columns.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def write_snapshot(df: DataFrame, root: str, version: int) -> str:
    """A table's next snapshot in a folder of its own, made from the version before it; readers see it when it is complete."""
    return SnapshotStore(df.sparkSession, root).commit({"table": df}, version - 1).tables["table"]["path"]


def latest_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """The newest snapshot, with or without rows; never one that is still being written."""
    return SnapshotStore(spark, root).read("table")


def page_of(c: Column | str) -> Column:
    return N.text(c)
