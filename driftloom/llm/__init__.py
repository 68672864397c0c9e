"""Training-data operators: ten corpus-scale operations, each usable on its own.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; ``queries.py`` binds them to the tables and fixes their parameters.
"""
