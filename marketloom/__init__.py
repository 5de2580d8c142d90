"""Market-data, news-sentiment and filing-fact analytics as Spark plans."""
