"""Cross-chain bridge analytics as plain Spark DataFrame jobs.

    feeds (JSON payloads) -> bridge relation -> reports

* ``sources``   feed schemas, readers and the date-partitioned bridge table
* ``functions`` column expressions: numeric cleaning, USD sums, calendar, labels
* ``operators`` DataFrame -> DataFrame building blocks
* ``plans``     the thirteen reports
* ``fixtures``  raw-shaped test feeds derived from the driver's tables, and SQL
"""
