"""maskfold: subspace-mask outlier analytics expressed as Spark DataFrame operators.

Every public operator is a function ``DataFrame -> DataFrame``.  Rows carry an
explicit ``row_id``; nothing relies on positional order.
"""

__version__ = "0.1.0"
