"""Operators for preparing training data, each a module; ``queries`` registers them."""
