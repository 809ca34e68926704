"""Sources and sinks: driver tables, canonical fixtures, topics, caches."""
