"""Readers and writers of landed files and snapshots."""
