"""churnlab: churn analytics for policyholder tables, expressed as Spark DataFrame plans.

Every public function takes and returns a ``pyspark.sql.DataFrame`` (or a small
driver-side scalar derived from a one-row aggregate). Heavy work stays inside
Spark: joins, grouping, windows and shuffles. See README.md for the map from
the survey's operator inventory to modules.
"""

__version__ = "0.1.0"
