"""Vertex programs, the loop that runs them, and tables that cut lineage."""
