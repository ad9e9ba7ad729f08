"""Whole queries: synthesis, snapshots, differences, exports, and the driver's queries."""
