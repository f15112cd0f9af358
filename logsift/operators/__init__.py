"""DataFrame-to-DataFrame operators of the pipeline."""
