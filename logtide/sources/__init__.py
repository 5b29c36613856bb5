"""Readers, writers and the stored runs."""
