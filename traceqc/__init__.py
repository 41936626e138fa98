"""traceqc: Spark jobs for cohorts of waveform reports."""

import sys

from pyspark import cloudpickle

# Functions that run inside Arrow tasks travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
