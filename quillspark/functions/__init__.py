"""Column functions: text, cells of spreadsheets, scores."""
