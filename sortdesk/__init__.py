"""Message triage, review and audit as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Helpers that run inside Python tasks travel with the job, so executors need no copy of
# this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
