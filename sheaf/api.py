"""A thin facade: the archive as an object over a versioned store, and the query catalogue as data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.operators import archive as A
from sheaf.sources.store import Store, delete_cascade

SETTINGS = {"shuffle_partitions": ("spark.sql.shuffle.partitions", "200"), "max_partition_bytes": ("spark.sql.files.maxPartitionBytes", "134217728"), "adaptive": ("spark.sql.adaptive.enabled", "true")}


class Archive:
    """Search, boards and maintenance over the tables of a store: documents, obligations, document_seals, document_subjects, risk_clauses."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)

    def _table(self, name: str, ddl: str) -> DataFrame:
        found = self.store.table(name)
        return found if found is not None else self.spark.createDataFrame([], ddl)

    @property
    def documents(self) -> DataFrame:
        return self._table("documents", "id bigint, sha256 string, status string, doc_type string, title string, contract_name string, party_a string, party_b string, amount_cents bigint, sign_date string, expire_date string, auto_renewal int, completeness_status string, ingested_at string, primary_date string, primary_amount_cents bigint")

    @property
    def obligations(self) -> DataFrame:
        return self._table("obligations", "id bigint, doc_id bigint, actor string, action string, deadline string, ordering int")

    @property
    def seals(self) -> DataFrame:
        return self._table("document_seals", "id bigint, doc_id bigint, owner string, seal_type string, raw_text string, ordering int")

    @property
    def subjects(self) -> DataFrame:
        return self._table("document_subjects", "doc_id bigint, subject string, ordering int")

    @property
    def risks(self) -> DataFrame:
        return self._table("risk_clauses", "id bigint, doc_id bigint, clause_text string")

    def ingest(self, rows: DataFrame) -> int:
        """Insert documents with a new hash; how many there were."""
        return self.store.insert("documents", rows)

    def search(self, flt: A.SearchFilter) -> DataFrame:
        return A.search(self.documents, flt, obligations=self.obligations, seals=self.seals, subjects=self.subjects, risks=self.risks)

    def list(self, **options) -> DataFrame:
        return A.list_documents(self.documents, **options)

    def todo(self, **options) -> DataFrame:
        return A.todo(self.obligations, self.documents, **options)

    def seal_board(self, **options) -> DataFrame:
        return A.seal_board(self.seals, self.documents, **options)

    def stats(self, as_of: str) -> DataFrame:
        return A.stats(self.documents, as_of)

    def show(self, ident: str) -> DataFrame:
        return A.hydrate(A.resolve(self.documents, ident), self.obligations, self.seals)

    def delete(self, ident: str) -> None:
        """Delete one document with its children."""
        names = self.store.state()["tables"]
        ids = A.resolve(self.documents, ident).select("id")
        self.store.commit(delete_cascade({n: self.store.table(n) for n in names}, ids))

    def compact(self) -> None:
        for name in self.store.state()["tables"]:
            self.store.compact(name)


def settings(spark: SparkSession, given: dict[str, str] | None = None) -> DataFrame:
    """Each setting with its value and where that is from: given, session or default; blank counts as unset."""
    rows = []
    for name, (conf, default) in SETTINGS.items():
        own, session = (given or {}).get(name, "").strip(), (spark.conf.get(conf, None) or "").strip()
        rows.append((name, own or session or default, "given" if own else "session" if session else "default"))
    return spark.createDataFrame(rows, "name string, value string, source string")


def capabilities(spark: SparkSession) -> DataFrame:
    """The catalogue: every query with whether SQL checks it."""
    from sheaf.plans.core import QUERIES, SQL

    return spark.createDataFrame([(n, n in SQL) for n in sorted(QUERIES)], "query string, has_sql boolean").orderBy(F.col("query"))
