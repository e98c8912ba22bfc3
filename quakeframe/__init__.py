"""quakeframe: earthquake early-warning data preparation, scoring and evaluation on Spark.

Everything is expressed as DataFrame operations (joins, aggregations, windows over
bounded groups, higher-order array functions); Python runs on executors only inside
the Arrow-batched model call (``operators.scoring``).
"""

from quakeframe.session import get_session, shared_dir

__all__ = ["get_session", "shared_dir"]
__version__ = "0.1.0"
