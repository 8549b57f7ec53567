"""perilframe: natural-hazard exposure and loss analytics as PySpark DataFrame jobs.

Sub-packages
------------
functions   Column expressions (distance, wind, damage, policy terms, labels, arrays)
operators   DataFrame -> DataFrame operators (joins, aggregates, windows, pairs, metrics)
sources     readers and writers for the raw feeds and the lake tables
streaming   the Structured Streaming ingest path
plans       end-to-end compositions (event losses, feature table, training table, tail risk)
catalog     registered queries over the test tables, each with its DuckDB twin
"""
