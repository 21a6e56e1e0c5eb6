"""shopstream: a Spark-native clickstream recommender and catalog analytics library.

Every public function takes DataFrames and returns DataFrames; nothing is
collected to the driver except one-row scalars (a percentile cap, a max
timestamp) that parameterise later plans.
"""

__version__ = "0.1.0"
