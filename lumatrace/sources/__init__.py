"""Sources and sinks: files, metadata, stored tables."""
