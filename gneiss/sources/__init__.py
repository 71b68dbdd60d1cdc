"""Sources: sessions, in-memory lists, text, parquet and document stores."""
