"""Market-volatility analytics as Spark DataFrame operators."""
