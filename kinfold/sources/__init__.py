"""Readers and writers: pedigrees, variant files, instruments, side tables, stored studies."""
