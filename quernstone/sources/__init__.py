"""Where data and settings come from."""
