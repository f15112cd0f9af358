"""Readers and writers for log files, corpora, fitted tables and results."""
