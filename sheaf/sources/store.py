"""The archive's tables as versioned parquet: writes are plans over whole tables, a commit swaps a pointer.

A version directory is written in full before the pointer file names it, so readers see the old version or the new one
and a lost executor only repeats a task.  One writer at a time.  Ids are never reused: the high-water mark is kept.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheaf.sources.tables import materialise

CHILDREN = ("obligations", "document_seals", "document_subjects", "risk_clauses")


def first_by(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key by an order: an aggregate, so a key that holds very many rows is combined before the shuffle."""
    best = df.groupBy(F.col(key).alias("_key")).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row"))
    return best.select("_row.*")


def new_rows(existing: DataFrame, incoming: DataFrame, key: str = "sha256") -> DataFrame:
    """Incoming rows whose key is not there yet (insert, or do nothing on conflict)."""
    return incoming.join(existing.select(key), key, "left_anti")


def with_ids(rows: DataFrame, high_water: int, *order: str) -> DataFrame:
    """Ids after the high-water mark in an order.

    Row numbers need no single task: partitions are ranged by the order, numbered within, and offset by a prefix sum of
    their counts (one number a partition).  The ranges are written once, so that counting and numbering see the same."""
    ranged = materialise(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    w = Window.partitionBy("_part").orderBy(*order)
    numbered = ranged.withColumn("_n", F.row_number().over(w))
    sizes = numbered.groupBy("_part").agg(F.max("_n").alias("_size"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_size")  # one row a partition
    return numbered.join(F.broadcast(before), "_part").withColumn("id", F.col("_n") + F.col("_before") + F.lit(high_water)).drop("_part", "_n", "_before")


def upsert(existing: DataFrame, updates: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Existing rows with those of equal key replaced by the updates; ``keep`` columns stay as they were; no inserts."""
    fresh = updates.join(existing.select(key, *keep), key) if keep else updates.join(existing.select(key), key, "left_semi")
    return existing.join(updates.select(key), key, "left_anti").unionByName(fresh.select(existing.columns))


def replace_children(children: DataFrame, fresh: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """Children of the documents ``doc_ids`` (doc_id) replaced by the fresh ones."""
    return children.join(doc_ids.select("doc_id"), "doc_id", "left_anti").unionByName(fresh)


def delete_cascade(tables: dict[str, DataFrame], ids: DataFrame, parent: str = "documents") -> dict[str, DataFrame]:
    """All tables without the documents ``ids`` (id) and their children."""
    gone = ids.select("id")
    out = {parent: tables[parent].join(gone, "id", "left_anti")}
    for name, df in tables.items():
        if name != parent:
            out[name] = df.join(gone.withColumnRenamed("id", "doc_id"), "doc_id", "left_anti")
    return out


def failed_outcome(old_status: str, old_dir: str, new_dir: str):
    """Where a failed re-ingest points: to the old outputs only if they were good and are still there."""
    keep = F.col(old_status).isin("ok", "partial") & F.col(old_dir).isNotNull()
    return F.when(keep, F.col(old_dir)).otherwise(F.col(new_dir))


def actions(scanned: DataFrame, documents: DataFrame) -> DataFrame:
    """What an ingest would do with each scanned file (sha256): new, retry (known but failed) or skip."""
    known = documents.select("sha256", F.col("status").alias("_s"))
    both = scanned.join(known, "sha256", "left")
    return both.withColumn("action", F.when(F.col("_s").isNull(), "new").when(F.col("_s") == "failed", "retry").otherwise("skip")).drop("_s")


class Store:
    """Versioned tables under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _read(self, name: str) -> str | None:
        p = self._path(f"{self.root}/{name}")
        if not self._fs.exists(p):
            return None
        return self.spark.read.text(f"{self.root}/{name}", wholetext=True).head()[0]

    def state(self) -> dict:
        """The pointer: table names to version folders, and the high-water mark of ids."""
        text = self._read("CURRENT")
        return json.loads(text) if text else {"tables": {}, "high_water": 0}

    def table(self, name: str) -> DataFrame | None:
        path = self.state()["tables"].get(name)
        return self.spark.read.parquet(f"{self.root}/{path}") if path else None

    def commit(self, tables: dict[str, DataFrame], high_water: int | None = None, partition: dict[str, str] | None = None) -> None:
        """Write new versions of tables, then swap the pointer to them."""
        state = self.state()
        for name, df in tables.items():
            path = f"{name}/v-{uuid.uuid4().hex}"
            writer = df.write
            if partition and name in partition:
                writer = writer.partitionBy(partition[name])
            writer.parquet(f"{self.root}/{path}")
            state["tables"][name] = path
        state["high_water"] = max(state["high_water"], high_water or 0)
        fresh = self._path(f"{self.root}/CURRENT-{uuid.uuid4().hex}")
        out = self._fs.create(fresh)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        self._replace(fresh, self._path(f"{self.root}/CURRENT"))

    def _replace(self, fresh, old) -> None:
        """Rename over the pointer: readers find the old one or the new one, never none."""
        sc = self.spark.sparkContext
        rename = getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename")
        over = sc._gateway.new_array(rename, 1)
        over[0] = rename.OVERWRITE
        sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), sc._jsc.hadoopConfiguration()).rename(fresh, old, over)

    def insert(self, name: str, incoming: DataFrame, key: str = "sha256", arrival: str = "ingested_at") -> int:
        """Insert rows with new keys; the rows inserted.  Of rows of one key the first to arrive counts, where the column
        ``arrival`` is there.  Rows and high-water mark are one commit."""
        mark, existing = self.state()["high_water"], self.table(name)
        order = [c for c in (arrival,) if c in incoming.columns] + [c for c in sorted(incoming.columns) if c not in (key, arrival)]
        incoming = first_by(incoming, key, *order)
        fresh = materialise(with_ids(new_rows(existing, incoming, key) if existing is not None else incoming, mark, key), "fresh")
        n = fresh.count()
        self.commit({name: existing.unionByName(fresh.select(existing.columns)) if existing is not None else fresh}, high_water=mark + n)
        return n

    def delete(self, ids: DataFrame, parent: str = "documents") -> None:
        names = self.state()["tables"]
        self.commit(delete_cascade({n: self.table(n) for n in names}, ids, parent))

    def compact(self, name: str, file_bytes: int = 256 << 20) -> None:
        """Rewrite a table into files of about ``file_bytes``, each by a task of its own."""
        size = self._fs.getContentSummary(self._path(f"{self.root}/{self.state()['tables'][name]}")).getLength()
        self.commit({name: self.table(name).repartition(max(1, -(-size // file_bytes)))})
