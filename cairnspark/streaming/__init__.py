"""Structured Streaming forms of the log reports and of incremental refresh."""
