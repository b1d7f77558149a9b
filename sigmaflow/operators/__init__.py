"""Operators: DataFrame -> DataFrame transformations keyed by ``series``."""
