"""Stages of a synthesis as DataFrame transformations."""
