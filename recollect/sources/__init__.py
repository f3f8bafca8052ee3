"""Tables, readers, writers and adapters."""
