"""Column functions: text, similarity, scores, languages, rendering."""
