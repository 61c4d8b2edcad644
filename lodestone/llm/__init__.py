"""Operators for training-data pipelines. Each module holds one operator.

Nothing outside this subpackage imports it. ``queries`` binds the operators to
the tables of a data folder.
"""
