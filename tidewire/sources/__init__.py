"""Sources and sinks: table readers, feeds, archives and exports."""
