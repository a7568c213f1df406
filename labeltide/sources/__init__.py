"""Delimited readers (``delimited``) and the corpus registry (``registry``)."""
