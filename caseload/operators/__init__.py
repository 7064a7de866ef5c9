"""Operators on DataFrames.

Operators are lazy, except where a small table has to be measured before it is
joined to raw rows, or where fits must not run twice: those write it once through
``caseload.session.materialise``.
"""
