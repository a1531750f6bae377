"""Graph analytics on Spark DataFrames: graphs are tables of vertices and edges, and queries are
vertex programs that become joins, aggregates and projections."""
