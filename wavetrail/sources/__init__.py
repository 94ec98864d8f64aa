"""Readers and writers of landed data."""
