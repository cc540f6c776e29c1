"""Functions on sequences, variants and alleles: Column expressions, Arrow functions, and their SQL names."""
