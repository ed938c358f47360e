"""Operators of a training-text pipeline. Nothing else in the library imports them.

Columns of the rows pass through under any names but those with two leading underscores, which are the operators' own.
"""
