"""Codec stages as DataFrame transformations over tables of blocks, symbols, codes, pixels and segments."""
