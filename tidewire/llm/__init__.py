"""Operators for preparing language-model training text.

Nothing else in the library imports this subpackage. Each module holds one operator with its
general interface; ``queries`` binds them to the test tables.
"""
