"""Sources and sinks: CSV, JSON, Parquet and literal rows with a row index; models; the catalog."""
