"""pathlens: touchpoint and customer-journey analytics as Spark DataFrame jobs.

Every public function takes DataFrames (or a SparkSession plus paths) and returns
lazy DataFrames; nothing is collected unless a function says so.
"""

__version__ = "0.1.0"
