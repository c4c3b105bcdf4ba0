"""Where traces come from: log discovery, wire decoding, incremental ingestion, tailing."""
