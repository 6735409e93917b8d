"""Readers, feed mappers and writers."""
