"""Domain views over the test tables, and the catalogue of named queries."""
