"""Panel analytics as DataFrame-to-DataFrame operators on Spark.

Layout
------
``functions``   Column expressions (typing, scores, labels); no shuffles.
``operators``   DataFrame in, DataFrame out; joins, windows and aggregations.
``sources``     readers, sinks and the views derived from the test tables.
``streaming``   Structured Streaming forms of the stateful alert and regime rules.
``plans``       registered queries and the ANSI SQL they are checked against.
"""
