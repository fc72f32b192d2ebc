"""Market-data analytics on PySpark: canonical trades and books, timelines, valuation, data sets and rankings."""
