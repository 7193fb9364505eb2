"""Driver-side planning: query text to syntax tree, checks, result types, and native lowering."""
