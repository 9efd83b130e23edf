"""ledgerline: decision-log analytics on PySpark DataFrames."""
