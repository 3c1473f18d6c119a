"""Reusable plan shapes: blocked windows, merges, top-k, table snapshots."""
