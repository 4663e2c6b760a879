"""A governed corpus of source documents under watch, as Spark plans."""
