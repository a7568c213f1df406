"""The stateless cleaning + scoring path applied to a file stream (``files``)."""
