"""Functions from Column to Column: texts, URLs, dates, coercion, expressions, templates, records."""
