"""Relational operators: journals, nested records, listings, invoices, sinks."""
