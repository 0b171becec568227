"""Registered queries (Spark side and SQL oracle side)."""
