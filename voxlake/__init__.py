"""voxlake: volume, time-series and network statistics as Spark DataFrames."""
