"""Operators for preparing training text at scale.

Each module holds one operator with a general interface; ``queries`` binds them
to the tables ``documents``, ``pages``, ``benchmark`` and ``embeddings``.  Code
that runs in Python workers is sent with the plan, so workers need no copy of
this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
