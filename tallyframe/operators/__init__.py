"""DataFrame-to-DataFrame steps, usable with ``DataFrame.transform``."""
