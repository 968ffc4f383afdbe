"""quagmark: analytics on irregular time series, acquisition networks and gridded observations, on Spark DataFrames."""

__version__ = "0.1.0"
