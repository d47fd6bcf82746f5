"""DataFrame operators: counting, profiling, quality, metrics, dependencies, checks."""
