"""Operators on long tables.

Every table carries key columns (such as subject and session), which stand for
the loops of the study: an operator adds them to its joins, groups and windows,
so a loop needs no driver. Index columns are named, never positional.
"""
