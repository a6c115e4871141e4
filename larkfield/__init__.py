"""larkfield: query-log, geospatial search and result-comparison operators on Spark DataFrames."""
