"""Readers and writers of the usage log."""
