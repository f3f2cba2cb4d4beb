"""Column functions (JVM side) and the small numeric kernels run inside tasks."""
