"""Weight algebras, time vectors, histograms."""
