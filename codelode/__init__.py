"""codelode: source-code review analytics as Spark DataFrame plans."""
