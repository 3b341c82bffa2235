"""Commerce analytics jobs on PySpark: staging, facts, marts, metrics, streams, forecasts."""
