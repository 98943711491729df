"""Tidewell: full-text search and web-crawl analytics as Spark plans."""
