"""Evidence analytics over text, code and labelled findings, as Spark DataFrame pipelines."""
