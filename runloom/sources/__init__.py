"""Readers, writers and the change log."""
