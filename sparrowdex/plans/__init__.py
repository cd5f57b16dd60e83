"""The query language, its rewrites, the batch compiler, task pipelines."""
