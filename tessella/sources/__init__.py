"""Sources and sinks of the catalogue."""
