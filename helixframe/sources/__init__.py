"""Sources and sinks: driver tables, file readers, writers and stand-in views."""
