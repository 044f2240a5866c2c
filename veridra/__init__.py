"""Schema-driven checking, profiling and shaping of records on Spark."""
