"""Tables partitioned by year, and the keys that hold them together."""
