"""termforge: term-structure forecasting and calibration on Spark DataFrames."""
