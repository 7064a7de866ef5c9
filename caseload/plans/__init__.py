"""Report tables and the end-to-end run."""
