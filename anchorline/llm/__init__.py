"""Training-data operators: near-duplicate search, classifiers, tokenisation, packing and vector search as Spark jobs."""
