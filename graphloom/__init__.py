"""graphloom: tabular data to labelled property graphs, on Spark."""
