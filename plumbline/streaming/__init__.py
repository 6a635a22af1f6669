"""Append-only run ledgers as streams."""
