"""Training-data operators over document corpora.

One module per operator; ``queries`` registers the thin ``opN_<name>`` queries
and their DuckDB twins. Nothing outside this package imports it.
"""
