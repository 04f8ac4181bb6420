"""Analytics over code bases and text corpora on Spark."""
