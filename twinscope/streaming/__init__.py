"""twinscope streaming."""
