"""Parsers of landed content into canonical records."""
