"""Registered queries, test views, reports and snapshots."""
