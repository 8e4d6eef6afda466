"""Readers and writers: ingestion sources, sinks, the registry of derived datasets."""
