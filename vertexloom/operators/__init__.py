"""Construction, access and partitioning of graphs."""
