"""twinscope sources."""
