"""Readers, writers, digests, the table catalog and derived demonstration tables."""
