"""Sources and sinks: JSON-lines journals, Arrow IPC files, checksummed frames."""
