"""Readers and writers, batch and streaming."""
