"""SQL transformations and the worked pipelines."""
