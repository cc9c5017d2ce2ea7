"""All registered queries of the library."""

from scrivane.plans import chunk_queries, corpus_queries, detail_queries, office_queries, page_queries, record_queries, scalars, stream_queries, surface_queries, whole_queries  # noqa: F401
from scrivane.plans.registry import ORACLES, QUERIES  # noqa: F401
