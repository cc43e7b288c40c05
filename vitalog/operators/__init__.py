"""DataFrame-in, DataFrame-out operators; none of them runs a Spark job unless it says so."""
