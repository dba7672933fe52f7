"""Operators: functions from DataFrames to DataFrames."""
from weftline.operators.aggregate import Agg, exact_median, summarize
from weftline.operators.balance import resample_classes
from weftline.operators.blend import (
    JoinSplit, inner_join, join_split, union_by_name, union_by_position, unmatched,
)
from weftline.operators.concat import concat_text
from weftline.operators.dedup import UniqueSplit, duplicate_rows, unique_rows, unique_split
from weftline.operators.fuzzy import fuzzy_match, fuzzy_pairs
from weftline.operators.gaps import ts_fill
from weftline.operators.markup import infer_xml_type, xml_parse
from weftline.operators.parse import (
    datetime_format, datetime_parse, infer_json_type, json_parse, regex_match, regex_parse,
    regex_replace, regex_tokenize, split_to_columns, split_to_rows,
)
from weftline.operators.preview import Preview, StepCounts, preview
from weftline.operators.profile import column_profile
from weftline.operators.project import Field, FilterSplit, filter_split, formula, select_fields
from weftline.operators.query import sql_inputs, sql_schema
from weftline.operators.recurrence import recurrence
from weftline.operators.replacing import find_replace
from weftline.operators.reshape import crosstab, transpose, unpivot
from weftline.operators.sampling import (
    row_index, sample_every_n, sample_first, sample_last, sample_random_n, sample_random_pct,
    sort_rows, top_k,
)
from weftline.operators.tiles import tile
from weftline.operators.timejoin import asof_join, range_join
from weftline.operators.userfn import (
    python_aggregate, python_batches, python_frames, python_groups,
)
from weftline.operators.windows import Win, ordered_window, qualify

__all__ = [
    "Agg", "Field", "FilterSplit", "JoinSplit", "Preview", "StepCounts", "UniqueSplit", "Win",
    "asof_join", "column_profile", "concat_text", "crosstab", "datetime_format", "datetime_parse", "duplicate_rows", "exact_median", "filter_split", "find_replace",
    "formula", "fuzzy_match", "fuzzy_pairs", "infer_json_type", "infer_xml_type", "inner_join", "join_split", "json_parse", "ordered_window",
    "preview", "python_aggregate", "python_batches", "python_frames", "python_groups", "qualify",
    "range_join", "recurrence", "regex_match", "regex_parse", "regex_replace", "regex_tokenize",
    "resample_classes", "row_index",
    "sample_every_n", "sample_first", "sample_last", "sample_random_n", "sample_random_pct",
    "select_fields", "sort_rows", "split_to_columns", "split_to_rows", "sql_inputs", "sql_schema",
    "summarize", "tile", "top_k", "transpose", "ts_fill", "union_by_name", "union_by_position", "unique_rows",
    "unique_split", "unmatched", "unpivot", "xml_parse",
]
