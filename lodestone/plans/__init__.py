"""Registered queries: each name maps to a Spark callable and an oracle."""
