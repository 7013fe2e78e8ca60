"""Where rows come from and go to: snapshot tables, readers, object stores and the ingest boundary."""
