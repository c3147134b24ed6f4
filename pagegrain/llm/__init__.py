"""Training-data operators: one module an operator, one registered query each."""
