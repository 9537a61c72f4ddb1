"""Operators for preparing training text at corpus scale.

Nothing outside this subpackage imports it.  ``queries`` maps each registered
query to its callable, ``oracles`` gives the SQL of those that SQL can express.
"""
