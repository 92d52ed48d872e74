"""Training-data operators: one module per operator, all independent of the rest of the library."""
