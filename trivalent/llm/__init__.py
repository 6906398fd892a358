"""Training-data operators: one module per operator, ``queries`` for the registered queries."""
