"""Column functions: exact integer roots, primality, bands, packing, digests."""
