"""Everyday table and stream work as DataFrame-to-DataFrame functions on PySpark."""
