"""Structured Streaming forms of the crawl: deduplication, schedules, upserts in batches, caches, windows."""
