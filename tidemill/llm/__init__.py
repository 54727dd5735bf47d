"""Training-data operators: one module for each, and `queries` with the registered queries."""
