"""Readers and writers: JSON lines, result documents, domains and configurations."""
