"""Operators: DataFrame -> DataFrame functions, one module per area."""
