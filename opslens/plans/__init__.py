"""Plan-shape helpers and the query registry."""
