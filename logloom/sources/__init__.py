"""Reading and writing log data."""
