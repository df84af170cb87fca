"""Readers of scan records, symbol documents, interface text, source text and file listings."""
