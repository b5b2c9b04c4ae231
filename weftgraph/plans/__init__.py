"""The graph projection of the driver's tables, and the catalogue of queries."""
