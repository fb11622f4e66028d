"""Part of the text and chat data engine."""
