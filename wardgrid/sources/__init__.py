"""Readers, inventories and sinks."""
