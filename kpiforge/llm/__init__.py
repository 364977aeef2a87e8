"""Training-data operators: packing, line rules, near-duplicates, tokens, extraction.

Each module holds one operator and takes DataFrames plus plain parameters;
``queries`` registers the digest queries.  Nothing else in the library imports
this package.  Task code travels to the Python workers by value, so executors
need only the public libraries, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
