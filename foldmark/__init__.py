"""Foldmark: a Spark-native engine for keyed state.

An ordered log of put and delete mutations is folded into a latest-value-per-key table with DataFrame
operations; sorted runs, data skipping, compaction, manifests, byte codecs and streaming ingestion are
built around that fold.
"""

__version__ = "0.1.0"
