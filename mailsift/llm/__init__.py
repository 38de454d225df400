"""Operators of a training-data pipeline over ``documents``, ``pages`` and ``benchmark``.

Nothing outside this subpackage imports it. Every operator module has a general function on a
DataFrame with named columns and a registered ``opN_<name>`` query on the given tables.
"""
