"""Relational, graph, lifecycle and metric operators as DataFrame programs."""
