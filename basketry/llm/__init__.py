"""Operations of a large-scale training-data pipeline.

Nothing else in the library imports this subpackage. One module per operator;
``queries.py`` applies them to the given tables, ``sql.py`` holds the DuckDB
SQL of those that SQL can express.
"""
