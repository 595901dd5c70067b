"""The batch limits that the operators on texts share."""

from memloom.functions.batches import BYTES, ROWS, bounded

__all__ = ["BYTES", "ROWS", "bounded"]
