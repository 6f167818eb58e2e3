"""Readers and writers of recordings, sheets and caches."""
