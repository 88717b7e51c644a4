"""graphloom: whole-program graph analytics, telemetry and data preparation on Spark DataFrames."""
