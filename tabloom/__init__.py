"""tabloom: record tables woven into typed entities, on Spark DataFrames."""

__version__ = "0.1.0"
