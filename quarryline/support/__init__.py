"""Tables for tests, rendering, resource samples and lineage events."""
