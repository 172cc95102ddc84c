"""Control-loop analytics on Spark: cleaning, indicators, roll-ups, diagnosis and reports as DataFrame plans."""
