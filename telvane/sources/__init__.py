"""Readers, writers and gates."""
