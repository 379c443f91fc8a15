"""Operators for preparing training corpora: ten operators, one module each.

Nothing outside this subpackage imports it.  ``queries`` holds the thin
queries that apply each operator to its whole table.
"""
