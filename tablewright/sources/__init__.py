"""Readers, writers, the dataset catalog and the shared test views."""
