"""Operators for preparing language-model training data at corpus scale.

Each module holds one operator. Nothing outside this subpackage imports it.
"""
