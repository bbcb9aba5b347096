"""Sources and sinks: tables, workbooks, versioned datasets."""
