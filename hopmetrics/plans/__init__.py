"""End-to-end reports."""
