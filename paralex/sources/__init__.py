"""Readers and sinks of parallel data, events and manifests."""
