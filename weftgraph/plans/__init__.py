"""Session settings and materialisation."""
