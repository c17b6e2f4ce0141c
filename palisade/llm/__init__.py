"""Training-data operators.  Nothing outside this subpackage imports it.

Every operator takes a DataFrame plus column names, keeps nothing of the input
but the id column, and returns its own columns: extra or clashing input
columns therefore never reach the result.
"""
