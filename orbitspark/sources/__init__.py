"""Readers and writers: messages, catalogue, tables, the adapter of the test tables."""
