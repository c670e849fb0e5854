"""Training-data pipeline operators.

One module per operator; ``queries.py`` binds each to its whole table and
``oracles.py`` holds the SQL. Nothing outside this package imports it.
"""
