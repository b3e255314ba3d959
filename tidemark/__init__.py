"""Event journals, temporal facts and retrieval as DataFrame transforms."""
