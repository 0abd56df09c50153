"""The query language and the registry of named queries."""
