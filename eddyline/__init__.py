"""Keyed event analytics on Spark: stores, windows, snapshots and streams as DataFrame plans."""
