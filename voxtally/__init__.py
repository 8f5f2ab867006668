"""voxtally: customer-review analytics written as Spark jobs.

Every operator takes DataFrames and returns a DataFrame; nothing in the
library collects rows to the driver.
"""

__version__ = "0.1.0"
