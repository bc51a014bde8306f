"""Tables, views over them, and readers and writers of the corpus formats."""
