"""ordergate: order-line quality gate and sales analytics on Spark DataFrames."""

__version__ = "0.1.0"
