"""ionflow: mass-spectrometry analytics and the relational and numeric operators behind them, on Spark DataFrames."""
