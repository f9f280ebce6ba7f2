"""A knowledge store and retrieval engine as DataFrame operators."""
