"""basketry — customer-basket analytics and segmentation on Spark DataFrames.

Every public operator is a plain function ``DataFrame -> DataFrame`` (or a
small family of them) meant to be chained with ``DataFrame.transform``.
"""

__version__ = "0.1.0"
