"""Family data derived from the provided tables, the registered queries and their SQL."""
