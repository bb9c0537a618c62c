"""Training-data operators: one module per operator, queries in ``queries.py``.

Nothing outside this folder imports it.  Python stages import this package on
the executors, so a cluster needs it installed there or shipped with --py-files.
"""
