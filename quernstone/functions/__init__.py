"""Column functions and chunking kernels."""
