"""stackpool: the data side of image-classification ensembles, as Spark DataFrame jobs."""
