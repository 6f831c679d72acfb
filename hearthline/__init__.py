"""Connected-device telemetry analytics as Spark DataFrame and Structured Streaming jobs.

Every operator takes DataFrames and returns a DataFrame.  Nothing here collects
rows to the driver, and "now" is always an explicit ``as_of`` argument, so a
run over the same tables always gives the same answer.
"""
