"""Readers, sinks and the logical views over the test tables."""
