"""Readers, writers and the driver-table mapping."""
