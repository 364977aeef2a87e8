"""Multi-output bundles (one per reference subcommand) and the query catalogue."""
