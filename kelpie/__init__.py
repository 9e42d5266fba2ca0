"""kelpie: corpus building, labelling, linking and evaluation as Spark DataFrames."""
