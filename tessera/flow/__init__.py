"""Dataflow of PHP code: atoms, taint through variables, and taint across calls."""
