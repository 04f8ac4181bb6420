"""Readers and writers of symbol tables, call edges, evidence, files and settings."""
