"""Training-data operators. Nothing outside this subpackage imports it; ``__spark_entry__`` registers its queries.

Each module holds one operator with its own interface; ``queries`` holds the registered ``opN_<name>`` queries, which
only derive digest columns from an operator's output, and ``oracles`` their SQL.
"""
