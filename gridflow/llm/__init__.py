"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Each module holds one operator with a general interface, and
`queries` holds the thin `opN_*` queries over the synthetic tables.
"""
