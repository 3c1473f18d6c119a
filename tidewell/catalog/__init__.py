"""Registered queries on the test tables; importing this fills the registry."""

from tidewell.catalog import corpus, knowledge, logs, retrieval, streams, tables  # noqa: F401
from tidewell.catalog.registry import QUERIES, SQL  # noqa: F401
