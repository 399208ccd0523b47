"""All queries of the core library; importing the modules registers them."""

from sheaf.plans import analysis_queries, archive_queries, data_queries, normal_queries, page_queries, record_queries, report_queries, stream_queries, text_queries  # noqa: F401
from sheaf.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
