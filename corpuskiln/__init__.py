"""corpuskiln: document analytics and grounded question answering as Spark DataFrame operators."""
