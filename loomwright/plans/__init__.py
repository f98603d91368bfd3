"""Catalog roll-ups, schema comparison and change plans."""
