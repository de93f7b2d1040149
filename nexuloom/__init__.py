"""Nexuloom: contextual-subgraph analytics on Spark."""
