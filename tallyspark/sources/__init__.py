"""Sources and sinks: the test tables, expense views, CSV import/export."""
