"""Multi-operator plans and the query registry."""
