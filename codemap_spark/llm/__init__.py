"""Training-data pipeline operators.

Nothing outside this subpackage imports it; ``queries.py`` lists its queries
for ``__spark_entry__``.
"""
