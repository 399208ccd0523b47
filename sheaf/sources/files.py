"""Files as tables: document files with their hashes, append-only JSON lines, evaluation cases, the registry's JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "ts string, pdf string, sha string, doc_id bigint, status string, mineru_s double, llm_s double, error string, op string, log_path string"
PARTIES = "version int, parties map<string,map<string,struct<value:string,first_seen_doc:string,first_seen_at:string,role:string>>>, aliases map<string,string>"


def document_files(spark: SparkSession, folder: str, pattern: str = "*.pdf", limit: int = 0) -> DataFrame:
    """(path, length, sha256) of files under a folder, no hidden ones or in hidden folders, in path order; ``limit`` 0: all."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder).toString()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    inner = F.substring_index(F.col("path"), root.rstrip("/") + "/", -1)
    seen = files.where(~inner.rlike(r"(^|/)[.]")).select("path", "length", F.sha2("content", 256).alias("sha256")).orderBy("path")
    return seen.limit(limit) if limit else seen


def json_lines(spark: SparkSession, path: str, ddl: str = LOG) -> DataFrame:
    """Rows of JSON lines with ``line_no`` within their file; blank and unreadable lines are skipped, unknown members ignored.

    Files are read whole so that line numbers hold across splits: logs are rolled, a file is a unit of work."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    parsed = lines.where(F.try_parse_json("line").isNotNull()).select("file", "line_no", F.from_json("line", ddl).alias("r"))
    return parsed.where("r is not null").select("file", "line_no", "r.*")


def append_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def cases(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluation cases (case_id, gold, text): folders with a gold.json and an input.txt."""
    read = lambda name, c: spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(folder, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("case_id"), F.col("value").alias(c))
    return read("gold.json", "gold").join(read("input.txt", "text"), "case_id").orderBy("case_id")


def registry_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(baselines, aliases) of a registry's JSON file; a missing, unreadable or misshapen one is empty."""
    try:
        whole = spark.read.text(path, wholetext=True)
        whole.head()
    except Exception:  # noqa: BLE001 - whatever keeps the file from being read leaves the registry empty
        whole = spark.createDataFrame([], "value string")
    parsed = whole.select(F.from_json("value", PARTIES).alias("r"))
    baselines = parsed.select(F.explode("r.parties").alias("canonical", "slot")).select("canonical", F.explode("slot").alias("label", "x")).select("canonical", "label", "x.*")
    return baselines, parsed.select(F.explode("r.aliases").alias("name", "canonical"))
