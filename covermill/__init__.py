"""Coverage-driven data selection on Spark: tokens per record, types, near-duplicates, covers, manifests."""

__version__ = "0.1.0"
