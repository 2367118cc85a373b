"""Incremental ingestion of arriving raw order files (Structured Streaming)."""

from cohortline.streaming.ingest import append_checked_batch, ingest_once, raw_stream, start_clean_ingest

__all__ = ["append_checked_batch", "ingest_once", "raw_stream", "start_clean_ingest"]
