"""Trading-signal analytics as Spark DataFrame operators.

Sub-packages: ``sources`` (tables, change streams, sinks), ``functions`` (column helpers),
``operators`` (one DataFrame step each), ``plans`` (the finished feeds) and ``streaming``
(the change-driven parts).  Operators are lazy: they take and return DataFrames and run no job.
"""
