"""panelcast: driver analysis and forecasting for panels of many series, on Spark DataFrames."""

__version__ = "0.1.0"
