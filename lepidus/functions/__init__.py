"""Scalar functions: Column expressions that stay inside code generation."""
