"""foldwise: DataFrame operators for k-fold scoring work on Spark.

Every public operator takes and returns ``pyspark.sql.DataFrame`` objects
(or ``Column`` expressions in :mod:`foldwise.functions`).  No operator
creates a session or changes global configuration.
"""

from foldwise.constants import TARGETS, SCORE_LEVELS  # noqa: F401

__version__ = "0.1.0"


def importable_by_workers(spark) -> None:
    """Let the session's local Python workers import this package.

    Operators that run Arrow Python (``mapInPandas``, ``applyInPandas``) pickle
    functions that refer to this package.  Workers started from another folder
    cannot import it.  This adds the package's parent folder to the
    ``PYTHONPATH`` that PySpark hands to workers for functions created
    afterwards.  On a cluster, ship the package with ``--py-files`` instead.
    """
    import os
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in parts:
        env["PYTHONPATH"] = os.pathsep.join([root, *parts])
