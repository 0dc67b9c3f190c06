"""Text kernels: plain functions of one string, applied by Arrow-batched UDFs over distinct texts (operators/text.py)."""
