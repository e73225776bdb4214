"""Part of the vellumgrid document-corpus engine."""
