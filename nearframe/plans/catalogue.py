"""All registered queries."""

from . import loading_queries, run_queries, stream_queries, text_queries, vector_queries  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
