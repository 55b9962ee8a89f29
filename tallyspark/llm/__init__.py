"""Training-data operators.  Nothing else in the library imports this
subpackage; it uses only general helpers of the library."""
