"""quillgraph: a Spark-first analytics engine for citation networks and training corpora."""
