"""BMP and JPEG files: parsing, decoding, encoding, and Spark data sources over them."""
