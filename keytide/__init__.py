"""Hot-key analytics on Spark: captures and cache traffic to events, events to reports."""
