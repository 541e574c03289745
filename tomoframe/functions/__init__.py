"""Column functions, and array kernels that run inside tasks."""
