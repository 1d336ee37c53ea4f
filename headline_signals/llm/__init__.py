"""Training-data pipeline operators over ``documents`` and ``pages``.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it. Functions that run
in Python workers are pickled by value, so workers need no installed copy.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
