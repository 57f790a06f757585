"""Image-codec data processing as Spark dataflow."""
