"""Operators for large text corpora: deduplication, extraction, tokenising, filtering, search, packing.

Nothing outside this subpackage imports it. Each module holds one operator with a general interface;
``queries`` registers the thin ``opN_<name>`` queries over the standard tables.
"""
