"""Analysis requests as streams."""
