"""Operators for preparing training text, with their queries and check SQL.

Nothing outside this package imports it.  Executors need the package on their Python path, as any
library with Python functions does (``--py-files`` on a cluster).
"""
