"""Sources and sinks: table scans, landed HTML, the dataset store and the catalog."""
