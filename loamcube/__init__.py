"""Analytics over irregular, partly masked image time series of several sensors, as Spark plans."""
