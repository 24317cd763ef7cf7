"""The registered queries and, where SQL can say the same, their SQL."""

from workload import facts, records, retrieval, texts  # noqa: F401  (registration)
from workload.registry import ORACLES, QUERIES  # noqa: F401
