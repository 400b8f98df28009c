"""driftwood: churn-style table analytics as Spark DataFrame operators.

Every operator takes DataFrames plus column names and returns a DataFrame;
nothing is collected to the driver except parameter tables whose size is
bounded by an argument (category lists, bucket boundaries, fitted scalers).
"""

__version__ = "0.1.0"
