"""Operators for preparing large language-model training corpora.

Nothing outside this subpackage imports it.  Each module holds one operator;
``queries`` registers the thin ``opN_`` queries over the shared tables.
"""
