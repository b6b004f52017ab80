"""Training-data operators: ten independent Spark operators and their queries.

Nothing else in the library imports this subpackage.
"""
