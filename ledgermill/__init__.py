"""Financial document ingestion and ledger analytics on PySpark."""
