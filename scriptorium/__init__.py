"""A Spark engine over corpora of LaTeX documents."""
