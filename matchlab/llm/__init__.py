"""Operators of a training-data pipeline; nothing else in the library imports them.

Import the module of the operator that is needed; this package loads none.
"""
