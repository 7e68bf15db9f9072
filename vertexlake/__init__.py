"""vertexlake: archetypal analysis and explanation on Spark DataFrames."""
