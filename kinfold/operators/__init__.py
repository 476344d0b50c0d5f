"""DataFrame-to-DataFrame operators: pedigrees, person sets, filters, reports, analytics."""
