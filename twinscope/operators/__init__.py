"""twinscope operators."""
