"""Named reports: each is a function of DataFrames returning a DataFrame.  Those that read one aggregate
several times store it first (``operators.share``), which runs that part when the report is built."""
