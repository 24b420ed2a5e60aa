"""Snapshots, object stores and versioned state tables."""
