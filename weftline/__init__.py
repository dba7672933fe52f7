"""weftline: table preparation and blending operators for PySpark.

Every operator is an ordinary function from DataFrames to DataFrames, so one
Catalyst plan covers a whole pipeline.  Import the pieces you need::

    from weftline import functions as fx
    from weftline.operators import filter_split, summarize, Agg
"""
from weftline.session import build_session, configure

__all__ = ["build_session", "configure"]
