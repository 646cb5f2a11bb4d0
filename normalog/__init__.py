"""Temporal rule analytics on PySpark."""
