"""Readers and writers: CSV layouts, chart JSON, packet captures, binary and columnar logs, synthetic feeds."""
