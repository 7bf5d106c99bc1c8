"""Column functions: boxes, text, markup, scores, images."""
