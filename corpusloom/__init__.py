"""corpusloom: building, curating and searching text corpora with Spark DataFrames."""
