"""Characters, token patterns, values and the language's functions; plain Python, no Spark."""
