"""Operators for preparing language-model training data.

Nothing outside this package imports it. Code that runs inside tasks is shipped with the job by
value, so executors need numpy, pyarrow and the small third-party libraries, but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
