"""twinscope functions."""
