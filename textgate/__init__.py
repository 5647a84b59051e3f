"""textgate: a PySpark engine that scores conversational text and promotes recurring violations to rules."""
