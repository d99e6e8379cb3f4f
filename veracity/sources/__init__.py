"""Sources and sinks: generation files, knowledge tables, vector index, fixture views."""
