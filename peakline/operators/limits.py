"""Counted sizes up to which the simpler plan is taken. Beyond each there is a plan without the bound."""

SHORT_SERIES = 1_000_000   # rows of a series in one percentile buffer
SMALL_GROUP = 1_000_000    # rows of one key sorted by a single window
FEW_BUCKETS = 100_000      # summary rows of one key folded by a single window
FEW_SERIES = 100_000       # rows of series scalars (a few numbers each) broadcast to the samples
