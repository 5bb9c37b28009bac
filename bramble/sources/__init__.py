"""Graph sources: edge lists, tables, catalog, generators; and stored tables."""
