"""Operators that prepare training data for language models.

Each module holds one operator as functions from DataFrame to DataFrame; ``queries`` wires
them to the tables.  Nothing outside this subpackage imports it.
"""
