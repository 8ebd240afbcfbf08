"""Page-observation analytics on Spark: rows of positioned characters, drawn boxes, markup tokens and evaluation records."""
