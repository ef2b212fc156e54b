"""Readers and writers: text records, key/value rows, pages, packages, advisories."""
