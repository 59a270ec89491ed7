"""Data quality, privacy and test-data operators over Spark DataFrames."""

from veilwork.session import cut_lineage, new_session

__all__ = ["cut_lineage", "new_session"]
