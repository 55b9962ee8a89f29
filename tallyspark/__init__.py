"""tallyspark: spending analytics as Spark DataFrame plans.

Every operator is a lazy function ``f(DataFrame, ...) -> DataFrame`` that
computes its answer for all users at once; one user is just a filter.
"""

__version__ = "0.1.0"
