"""Source-corpus analytics on Spark DataFrames.

Sub-packages:

* ``sources``    readers and writers (code folders, event logs, response caches)
* ``functions``  Column -> Column building blocks
* ``operators``  DataFrame -> DataFrame operators
* ``streaming``  Structured Streaming operators
* ``plans``      multi-table reports, derived tables and the query registry
"""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
