"""Query operators over semi-structured values."""
