"""Catalogue analytics on Spark: profiling, text features, similarity and price regression.

``sources``    schemas, readers, writers, the poster dimension
``functions``  Column -> Column expressions (no shuffle, whole-stage codegen)
``operators``  reusable DataFrame -> DataFrame operators (profiling, vectors, nearest rows, sampling)
``plans``      the three pipelines built from them: laptops, movies, price models
"""

import sys

from pyspark import cloudpickle

# Worker functions travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
