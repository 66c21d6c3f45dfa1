"""Imports every module of queries, so that the registry is filled."""

from quern.plans import answers, chunks, metrics, retrieval, streams, tables  # noqa: F401
from quern.plans.registry import QUERIES, SQL  # noqa: F401
