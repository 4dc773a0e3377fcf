"""Operators by data model: vectors, memory, keyed collections, time series, logs and versions, streams, merging state."""
