"""From file contents to symbol rows."""
