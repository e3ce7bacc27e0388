"""Training-data operators over document corpora; nothing else in the library imports this."""
