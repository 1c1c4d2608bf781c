"""Readers and writers: text, JSON, files, JDBC, catalog tables, keyed collections."""
