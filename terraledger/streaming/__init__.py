"""Incremental use of the batch stages from a stream of source records."""
