"""Feature quantification of sequencing alignments on Spark DataFrames."""
