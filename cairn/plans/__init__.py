"""Stand-in inputs and the registered queries with their check SQL."""
