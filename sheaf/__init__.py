"""File trees, text bundles, session logs and source catalogs as Spark tables."""

import sys

from pyspark.cloudpickle.cloudpickle import register_pickle_by_value

# The functions and sources that run in tasks travel with the job, so executors need no install.
register_pickle_by_value(sys.modules[__name__])
