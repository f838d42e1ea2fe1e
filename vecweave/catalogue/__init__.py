"""The named queries over the given tables, each with SQL for the same result where possible."""

from vecweave.catalogue import chunks, embeds, files, jobs, retrieval, stores, streams, vectors
from vecweave.catalogue.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "chunks", "embeds", "files", "jobs", "retrieval", "stores", "streams", "vectors"]
