"""The panel operators over arriving files."""
