"""Readers, writers, catalogs, manifests and snapshots."""
