"""Training-data operators: one module per operator, queries in ``queries.py``.

Nothing outside this subpackage imports it; the subpackage itself uses PySpark, pyarrow,
pandas and numpy, and also zstandard (op1, op3, op10), xxhash (op5) and tiktoken (op3, op9).
"""
