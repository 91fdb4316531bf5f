"""Log analytics on Spark: lines to records, batches, alerts and flow control.

Every operator is a function from DataFrame to DataFrame.  Row-wise work is
built from Spark column expressions, so the same code serves batch tables and
Structured Streaming.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The small task helpers travel with the job, so that workers need no copy of
# this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
