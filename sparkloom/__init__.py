"""sparkloom: ingestion, analytical SQL operators and metrics on plain PySpark."""
