"""Column functions: text measures, URLs, markup scraps."""
