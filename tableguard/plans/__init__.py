"""The validation pipeline and the queries that exercise it."""
