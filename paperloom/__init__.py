"""Document analytics on PySpark: DataFrame-to-DataFrame operators and Column functions."""
