"""Finding and anonymizing personal data in text, as Spark expressions."""
