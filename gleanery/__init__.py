"""Search web archives, or any table of texts, for many patterns at once."""

import sys

from pyspark import cloudpickle

# Functions sent to the Python workers travel by value, so executors need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from gleanery.plans.job import SearchResult, read_records, search_archives  # noqa: E402
from gleanery.plans.table import prepare_table, search_table  # noqa: E402

__all__ = ["SearchResult", "prepare_table", "read_records", "search_archives", "search_table"]
