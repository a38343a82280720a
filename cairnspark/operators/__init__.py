"""Relational operators over logs, notes, reports and rules."""
