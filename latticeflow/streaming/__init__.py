"""Column-ordered streams of tile summaries."""
