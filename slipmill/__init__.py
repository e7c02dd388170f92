"""slipmill: receipt-document analytics as PySpark DataFrame operators."""
