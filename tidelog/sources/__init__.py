"""Readers and writers: snapshots, change streams, versioned tables, exports."""
