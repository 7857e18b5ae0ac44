"""Operators over records, files, edges, the log and assets."""
