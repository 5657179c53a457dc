"""Readers and writers: CSV, JSON layouts, JDBC, Parquet, and JSON-safe value conversion."""
