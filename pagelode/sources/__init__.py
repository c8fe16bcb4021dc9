"""Readers and writers: document folders, the partitioned index store, the legacy flat index."""
