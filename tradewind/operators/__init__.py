"""Jobs beyond a single plan: loads, bulk order work, forecasts, affinity, sessions."""
