"""Named queries by family."""

from foliant.plans import collection, documents, metadata, rerank, retrieval, safety, streams, traffic  # noqa: F401
from foliant.plans.registry import ORACLES, QUERIES  # noqa: F401
