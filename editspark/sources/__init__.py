"""Sources and sinks: case tables in CSV, shards in JSON lines, submissions and summaries."""
