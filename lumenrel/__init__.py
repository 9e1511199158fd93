"""A relational engine on PySpark: SQL, JSON queries, versioned tables and grants."""
