"""helixframe: Spark-native analytics for biological sequence classifiers.

Every operator is a plain function over DataFrames or Columns:

* ``functions`` - Column builders (sequence cleaning, codons, mutation draws,
  softmax/entropy, formatting).
* ``operators`` - DataFrame -> DataFrame operators (labels, metrics, pooling,
  tokens, scoring, attacks).
* ``sources``   - readers, writers and the stand-in views over the driver tables.
* ``plans``     - the registered queries with their DuckDB oracles, and Spark ML.
* ``streaming`` - incremental (Structured Streaming) forms of batch operators.
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Pickle this package's functions by value inside UDFs.

    Python workers need not have the package installed or on their path (an
    Arrow UDF defined here would otherwise fail with ``No module named``).
    """
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_by_value()
