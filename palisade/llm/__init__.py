"""Training-data operators. Nothing outside this subpackage imports it.

Every operator picks its input columns by name, ignores all others and
returns columns of its own, so extra columns and clashing names are harmless.
"""
