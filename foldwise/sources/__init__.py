"""File sources and sinks (CSV / Parquet) and resumable writes."""
