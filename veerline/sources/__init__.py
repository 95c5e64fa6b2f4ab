"""Readers of raw corpora, and of ledgers; writers of ledgers, sidecars and manifests."""
