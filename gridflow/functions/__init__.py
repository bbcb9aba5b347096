"""Column functions: normalisation of texts and keys, typed conversion, and the scalar functions of expressions."""
