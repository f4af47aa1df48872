"""Readers, ingest and sinks at the edges of the dataflow."""
