"""Readers, writers, the synthetic ledger and the driver-table views."""
