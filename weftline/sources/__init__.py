"""Change logs, snapshots, catalog, program files."""
