"""factloom: code-facts analytics as PySpark DataFrame operators.

Every operator is a function from DataFrames (and parameters) to a DataFrame.
Nothing here holds rows on the driver; state that must outlive a job is a
table in the shared folder named by ``spark.checkpoint.dir``.
"""

__version__ = "0.1.0"
