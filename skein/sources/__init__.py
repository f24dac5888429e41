"""Sources and sinks: JSON lines, snapshots, ledgers, schema evolution."""
