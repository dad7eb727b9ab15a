"""fairlead: trips, port stays and voyage statistics from vessel telemetry, on Spark."""
