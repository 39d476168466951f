"""Where records go: upserts over stored tables, logs, exports."""
