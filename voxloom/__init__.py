"""voxloom: curation of speech transcripts and training text on Spark DataFrames."""
