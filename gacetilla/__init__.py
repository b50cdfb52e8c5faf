"""gacetilla: news items ranked by fuzzy lexicon relevance, as Spark jobs."""

import sys as _sys

__version__ = "0.1.0"

# Python code that runs inside tasks (the HTML cleaner UDF) is shipped with
# the task by value, so executors need not have this package installed.
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # an older serializer: the package must then be on the executors' path
    pass
