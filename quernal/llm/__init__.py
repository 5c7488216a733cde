"""Operators for preparing training corpora.

Nothing outside this subpackage imports it; ``queries`` holds what the
registry adds when the subpackage is present.
"""
