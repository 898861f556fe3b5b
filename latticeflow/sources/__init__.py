"""Sources: generated lattice scans, tile grids, regions, snapshots, documents."""
