"""Readers and writers: yearly matrices, long tables, stored results."""
