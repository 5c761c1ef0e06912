"""Column functions: expressions only, so they stay inside whole-stage codegen."""
