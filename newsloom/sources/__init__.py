"""Readers: every source comes back as a DataFrame with a declared schema."""
