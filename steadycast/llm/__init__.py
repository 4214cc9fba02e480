"""Operators for training corpora. Nothing outside this folder imports it.

Every operator selects the columns it needs by name, so further columns of its input, also
ones whose names it uses itself, do no harm. Rows with a null id are kept: null is an id of
its own and sorts first. Results do not depend on how the input is cut into partitions unless
a docstring says so.
"""
