"""Sources and sinks: text folders, tables, judged labels, harvested pages."""
