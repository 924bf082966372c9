"""Reading documents, dictionaries and listings."""
