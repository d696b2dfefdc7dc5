"""End-to-end analytics built from the operators."""
