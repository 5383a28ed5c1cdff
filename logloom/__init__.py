"""logloom: log analytics as plain PySpark DataFrame-to-DataFrame operators."""
