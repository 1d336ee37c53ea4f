"""End-to-end flows built from the operators, the query registry and the SQL oracle."""
