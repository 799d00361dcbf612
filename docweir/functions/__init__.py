"""Column functions: no state, no Python on the executors."""
