"""Training-data operators over document, conversation, page and embedding tables."""
