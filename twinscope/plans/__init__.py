"""twinscope plans."""
