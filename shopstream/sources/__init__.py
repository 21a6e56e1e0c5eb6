"""Sources and sinks: CSV ingest, Parquet I/O, JDBC, window export, fixture adapters."""
