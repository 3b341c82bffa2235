"""Readers, writers and the adapter from the driver tables to shop entities."""
