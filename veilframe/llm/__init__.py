"""Operators of a large-scale training-data pipeline (ten operators and their driver queries).

Nothing outside this subpackage imports it; deleting it leaves the rest of the library working.
"""
