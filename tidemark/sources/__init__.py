"""Readers, writers and table lifecycle."""
