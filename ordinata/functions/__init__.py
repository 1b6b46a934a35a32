"""Functions over columns: scalars, inner lists (arrays), Maybe and Either."""
