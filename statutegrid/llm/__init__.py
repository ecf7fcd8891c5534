"""Training-data operators: one module per operator, its query and its SQL beside it."""
