"""Sources and sinks: tables, event streams and the points table."""
