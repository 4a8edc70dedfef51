"""quillspark: script and language identification as DataFrame operations."""
