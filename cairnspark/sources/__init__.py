"""Readers: graph and note tables, logs, chunks, reports and source files, each to a DataFrame."""
