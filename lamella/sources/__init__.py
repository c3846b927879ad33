"""Reading and writing files, and what their footers say."""
