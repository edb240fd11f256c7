"""txnwatch: Spark-native fraud analytics over time-ordered transactions.

Every operator is a ``DataFrame -> DataFrame`` function built from Spark SQL
columns, windows, joins and aggregations, so it runs unchanged from a laptop
``local[*]`` session to a large cluster.
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Pickle this package's functions by value, so the few Arrow UDFs
    (``applyInPandas`` / ``mapInPandas`` bodies) run on executors that do not
    have the package installed."""
    import sys

    try:
        from pyspark import cloudpickle
    except ImportError:  # pragma: no cover - pyspark is a hard dependency
        return
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_by_value()
