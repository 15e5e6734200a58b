"""Named runs of every operator over the test data, with the SQL that checks them."""

from sigloom.registry.base import ORACLES, QUERIES
from sigloom.registry import batch, feeds, probes, streams  # noqa: F401 - registration on import

__all__ = ["ORACLES", "QUERIES"]
