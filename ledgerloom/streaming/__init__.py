"""Structured Streaming forms of the ledger: projection, bounded deduplication, staged rebuilds."""
