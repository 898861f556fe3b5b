"""Lattice connectivity analytics and training-data operators on Spark."""
