"""The expression language and its functions."""
