"""Readers: delimited text, JSON documents, workbooks, text artifacts."""
