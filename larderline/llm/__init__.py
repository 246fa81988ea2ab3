"""Operators for preparing training data, each a function from DataFrame to DataFrame.

Nothing else in the library imports this subpackage. ``queries`` registers one query per
operator; the pipeline that chains five of them lies beside the package.
"""
