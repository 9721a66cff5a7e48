"""Retrieval, as-of resolution and change analytics over dated snapshots of text, as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions used inside tasks travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
