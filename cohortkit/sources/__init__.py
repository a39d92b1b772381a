"""Where survey tables come from."""
