"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Each operator lives in a module of its own with a general
interface; ``entries`` holds the registered queries and ``oracles`` their SQL.
"""
