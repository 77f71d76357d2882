"""Column functions: matching with offsets, checksums, AES and hashing."""
