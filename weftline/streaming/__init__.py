"""Row-wise operators on streams.

`select_fields`, `formula`, `filter_split`, the unions and the split, regex and
date operators keep no state, so they take a streaming DataFrame as it is.
"""
from weftline.streaming.incremental import run_available

__all__ = ["run_available"]
