"""Training-data operators: ten document, page and vector operators and the corpus pipeline's parts."""
