"""Table schemas, readers, writers and bindings."""
