"""Whole plans: the flat graph, the tiled graph, and the checks between them."""
