"""ledgerloom: document analytics and retrieval over financial text, built on PySpark DataFrames."""
