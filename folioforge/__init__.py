"""folioforge: document collections to narration-ready text, on Spark DataFrames."""
